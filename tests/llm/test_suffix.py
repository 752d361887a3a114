import collections
import hashlib
import random

import numpy as np
import pytest

from tallyspark.llm import suffix

SF = "/root/testdata/sf0.001"


def brute(rows, length, keep_first=False):
    starts = collections.defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], i))
    for i in order:
        data = (rows[i][1] or "").encode()
        for p in range(len(data) - length + 1):
            starts[data[p : p + length]].append((i, p))
    gone = collections.defaultdict(set)
    for at in starts.values():
        if len(at) > 1:
            for i, p in at[1:] if keep_first else at:
                gone[i].update(range(p, p + length))
    out = []
    for i, (d, t) in enumerate(rows):
        data, g = (t or "").encode(), gone[i]
        kept = bytes(b for p, b in enumerate(data) if p not in g)
        runs = sum(p in g and p - 1 not in g for p in range(len(data)))
        out.append((d, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df, **kw):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove(suffix.stretches(df, **kw)).collect())


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abé ") for _ in range(k))
    shared = [word(rng.randint(20, 90)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([word(rng.randint(1, 40)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 10) : rng.randint(15, 60)], "ab" * rng.randint(1, 40)]) for _ in range(rng.randint(0, 6)))) for i in range(n)]
    return rows + [(1000 + i, t) for i, (_, t) in enumerate(rows[:5])] + [(2000, None), (2001, ""), (2002, "a" * 300)]


@pytest.mark.parametrize("keep_first, large", [(False, 2048), (True, 2048), (False, 2), (True, 2)])
def test_equals_brute_force(spark, keep_first, large):
    rows = texts(1 + keep_first + large)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, cls int").repartition(3)
    assert run(df, length=30, gram=8, keep_first=keep_first, large=large) == brute(rows, 30, keep_first)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert run(df) == brute(rows, 400)


@pytest.mark.parametrize("seed", range(4))
def test_factors(seed):
    rng = np.random.default_rng(seed)
    n = 60
    rows, group = rng.integers(97, 99, (n, 12)).astype(np.uint8), np.sort(rng.integers(0, 3, n))
    size = rng.integers(3, 13, n)
    rows[np.arange(12)[None, :] >= size[:, None]] = 255
    before, after = suffix.factors(*suffix.in_order(rows, size, group))

    def common(i, j):
        k = 0
        while k < min(size[i], size[j]) and rows[i, k] == rows[j, k]:
            k += 1
        return k

    for i in range(n):
        assert max(before[i], 0) == max([common(i, j) for j in range(i) if group[i] == group[j]], default=0)
        assert max(after[i], 0) == max([common(i, j) for j in range(i + 1, n) if group[i] == group[j]], default=0)


def test_query(spark):
    from tallyspark.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op7_suffix_dedup"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 400)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a" * 500), (1, "a" * 500)], "doc_id long, text string")
    assert [r[2] for r in run(df)] == [500, 500]
    assert run(df.limit(0)) == []
