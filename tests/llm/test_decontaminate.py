import random
import re

import numpy as np

from tallyspark.llm import decontaminate as g

SF = "/root/testdata/sf0.001"


def brute_tile(doc, item, k):
    """Greedy tiling by its definition: scan for the longest unmarked match, mark, repeat."""
    k = min(k, len(item))
    in_doc, in_item, tiles = [False] * len(doc), [False] * len(item), []
    while k:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < k:
            break
        tiles.append((j, i, n))
        in_doc[i : i + n] = in_item[j : j + n] = [True] * n
    return tiles


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_tiles_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        doc, item = [[rng.randrange(3) for _ in range(rng.randint(0, n))] for n in (30, 12)]
        want = brute_tile(doc, item, 3)
        got = g.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert got == want, (doc, item)


def sample(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    a, b = items[0][1], items[1][1]
    half = words(b)
    docs += [(1001, "x y z " + a.upper() + " tail"), (1002, " ".join(half[len(half) // 2 :] + ["cut", "in"] + half[: len(half) // 2])), (1003, None), (1004, ""), (None, a), (1001, "tiny item"), (1005, "a tiny item b")]
    items += [(900, "tiny item"), (901, None), (902, ""), (901, a)]
    return docs, items


def test_leaks_equal_brute_force(spark, monkeypatch):
    docs, items = sample(spark)
    want = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + k]) for k in (2, 5) for i in range(len(w) - k + 1)}
        for n, s in items:
            x = words(s)
            k = min(5, len(x))
            if any(tuple(x[i : i + k]) in grams for i in range(len(x) - k + 1)) and x:
                m = sum(z[2] for z in brute_tile(w, x, 5))
                if m >= g.COVERAGE * len(x):
                    want.add((d, n, m, len(x)))
    df = spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:4] for r in g.leaks(df, bench).collect()]
    assert set(got) == want and len(got) == len(want) and {1001, 1002, None} <= {r[0] for r in got}
    kept = {(r.doc_id, r.text) for r in g.clean(df, bench).collect()}
    bad = {d for d, *_ in want}
    assert kept == {(d, t) for d, t in docs if d not in bad} and g.clean(df, bench).columns == df.columns
    # a benchmark over the bound takes the joined way, with equal results
    monkeypatch.setattr(g, "BROADCAST_CHARS", 10)
    assert {tuple(r)[:4] for r in g.leaks(df, bench).collect()} == want
    assert {(r.doc_id, r.text) for r in g.clean(df, bench).collect()} == kept
    own = df.selectExpr("*", "'own' as __key")
    assert g.clean(own, bench).columns == own.columns and {(r.doc_id, r["__key"]) for r in g.clean(own, bench).collect()} == {(d, "own") for d, _ in kept}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert g.leaks(docs, bench).count() == 1
    assert g.leaks(docs.limit(0), bench).count() == 0 and g.leaks(docs, bench.limit(0)).count() == 0
    assert g.clean(docs, bench.limit(0)).count() == 1
