"""Hard negatives against every anchor and row compared."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import negatives
from tallyspark.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, row string"


def brute(rows):
    rows = [(i, [math.floor(256 * x) for x in v], (l_ + 1) % 10 if i % 7 == 0 else l_) for i, v, l_, *_ in rows if None not in (i, v, l_) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, v, own) in enumerate(rows):
        if a % 50:
            continue
        near = sorted((-sum(map(int.__mul__, v, w)), i, other) for m, (i, w, other) in enumerate(rows) if m != n and len(w) == len(v))
        for p, i, other in [x for x in near if x[2] == own][:5]:
            ok = [(s, j) for s, j, o in near if o != own and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(ok)]
    return sorted(out)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(df, F.col("vec_id") % 50 == 0, label)
    return sorted(map(tuple, got.collect()))


def test_equals_brute_force(spark, monkeypatch):
    """Small slices and blocks, ties, repeated rows, nulls, other lengths and very large components."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(10)]
    rows = []
    for i in range(700):
        c = centres[i % 10] if i % 3 else centres[0]
        rows.append((i, [round(x + rng.gauss(0, 0.3), 1) for x in c], i % 10 if i % 3 else 0, "s", "r"))
    rows += rows[:60]
    rows += [(50, None, 1, "", ""), (100, [1.0] * 6, None, "", ""), (None, [1.0] * 6, 1, "", ""), (150, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "", ""), (200, [float("nan")] * 6, 1, "", ""), (250, [float("inf")] * 6, 1, "", "")]
    rows += [(1000 + i, [1.0 + i % 3, 2.0], i % 2, "", "") for i in range(60)] + [(2000, [], 3, "", ""), (2001, [], 4, "", ""), (2003, [], 3, "", "")]
    rows += [(1050, [4e6, -1e-20], 1, "", ""), (1111, [3e6, 5e6], 1, "", ""), (1112, [2e6, 5e6], 0, "", "")]
    monkeypatch.setattr(negatives.trees, "__defaults__", (90,))
    monkeypatch.setattr(negatives.blocks, "__defaults__", (7, False))
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_products_stay_exact():
    a, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 1.0], [3.0, 2.0**30]])
    assert negatives._products(a, x).tolist() == [[2**80 + 1, 3 * 2**40 + 2**30]]


def test_trees_prune():
    """Far clusters are never looked at."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (200, 4)) for c in (0, 50, -50)]).round()
    t = negatives.ball_tree(x, np.repeat([1, 1, 1], 200))
    order = t.pop("order")
    t |= {"x": x[order], "row": order, "vec_id": order, "label": np.ones(600, int), "place": order.astype(np.int64)}
    calls = []
    real, negatives._products = negatives._products, lambda a, b: calls.append(len(b)) or real(a, b)
    try:
        q, at, score = negatives.search(t, np.array([[50.0] * 4]), np.array([1]), np.array([-1]), 5, np.array([0]), True)
    finally:
        negatives._products = real
    best = np.argsort(-(x @ np.full(4, 50.0)), kind="stable")[:5]
    assert sorted(t["vec_id"][at].tolist()) == sorted(best.tolist()) and sum(calls) <= 200


def test_empty(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1, "", "")], SCHEMA)) == []


def test_query(spark, tmp_path):
    rows = [(i, [math.sin(i * j) for j in range(1, 9)], i % 4, "", "") for i in range(300)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11_hard_negatives(spark, str(tmp_path))
    assert dict(got.dtypes)["rank"] == "int" and sorted(map(tuple, got.collect())) == brute(rows)


def test_nothing_grows_on_the_driver(spark, monkeypatch):
    """Trees of copies are small as files and large in memory."""
    seen, kept = [], negatives.written

    def watched(df, *args):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, *args)

    monkeypatch.setattr(negatives, "written", watched)
    rows = spark.range(400).selectExpr("id as vec_id", "array(id % 5 / 8D, 0.5D, -0.25D) as embedding", "cast(id % 3 as int) as label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = negatives.mine(rows, F.col("vec_id") % 50 == 0, label)
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(seen) == 4 and not any("Broadcast" in plan for plan in seen)
    assert sorted(map(tuple, out.collect())) == brute([(r.vec_id, r.embedding, r.label) for r in rows.collect()])
