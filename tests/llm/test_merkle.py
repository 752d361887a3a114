"""The manifest against trees built in a list."""

import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import merkle
from tallyspark.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, now string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def touched(r):
    hit = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    return {**r, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])} if hit else r


def brute(rows):
    if not rows:
        return []
    rows = sorted(rows, key=lambda r: (r["source"] is not None, (r["source"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    groups = [list(g) for _, g in itertools.groupby(rows, key=lambda r: r["source"])]
    trees = [levels([leaf(r) for r in g]) for g in groups]
    top, out = levels([t[-1][0] for t in trees]), []
    for g, (tree, members) in enumerate(zip(trees, groups)):
        for i, r in enumerate(members):
            fold, proof = leaf(touched(r)), ""
            for nodes, at in ((tree, i), (top, g)):
                for level in nodes[:-1]:
                    run, p = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:p] + run[p + 1 :])
                    fold, at = h("".join([*run[:p], fold, *run[p + 1 :]])), at // 16
            out.append((r["doc_id"], leaf(r), tree[-1][0], top[-1][0], h(proof), fold, fold == top[-1][0]))
    return out


CASES = {
    "empty": [],
    "one": [(1, "a", "x", 1, "Text")],
    "edges": [(10, "a", "x", 1, "T"), (10, "a", "x", 1, "T"), (None, None, None, None, None), (11, None, None, 3, "Äß"), (5, "", None, 3, ""), (6, "z", "x", 9, "LONG " * 200_000)],
    "runs": [(i, "a", "x", 1, f"T{i}") for i in range(257)],
    "sources": [(i, f"s{i % 40}" if i % 3 else "hot", "x", 1, f"T{i}") for i in range(500)],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(spark, case):
    df = spark.createDataFrame([(*r, "own", "own") for r in CASES[case]], SCHEMA)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    got = merkle.manifest(df.repartition(7), tampered)
    want = brute([r.asDict() for r in df.collect()])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_untouched_verifies(spark, tmp_path):
    rows = [(*r, "", "") for r in CASES["sources"]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert merkle.manifest(df).where("verified").count() == len(rows)
    assert op12_merkle_manifest(spark, str(tmp_path)).where("verified").count() < len(rows)
