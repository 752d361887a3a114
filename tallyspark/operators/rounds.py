"""Iterations over frames: a cut lineage each round, components, one-to-one assignment."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The frame by way of a reliable checkpoint in spark.checkpoint.dir; a temporary folder only for local sessions without one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir is unset")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def survivors(edges: DataFrame, most: int = 100) -> DataFrame:
    """node, survivor: the least node that each node of edges (a, b) reaches; nodes without edges aren't in it.

    Each round a node takes the least survivor among its neighbours', then that one's own, so rounds
    grow with the logarithm of the longest chain.  Its joins are merges: no round sends nodes through
    the driver.
    """
    both = edges.select("a", "b").where("a != b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("survivor")))
    for _ in range(most):
        heard = both.hint("merge").join(now.select(F.col("node").alias("b"), "survivor"), "b").groupBy(F.col("a").alias("node")).agg(F.min("survivor").alias("heard"))
        low = now.hint("merge").join(heard, "node").select("node", F.col("survivor").alias("was"), F.least("survivor", "heard").alias("low"))
        # a survivor also hears of what its own nodes have found
        told = low.groupBy(F.col("was").alias("node")).agg(F.min("low").alias("told"))
        low = low.join(told.hint("merge"), "node", "left").select("node", "was", F.least("low", F.coalesce("told", "low")).alias("low"))
        onward = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = cut(low.join(onward.hint("merge"), "low", "left").select("node", "was", F.coalesce("next", "low").alias("survivor")))
        now = new.select("node", "survivor")
        if new.where("survivor != was").isEmpty():
            return now
    raise RuntimeError("survivors did not settle")


def one_to_one(pairs: DataFrame, least: float | None = None, most: int = 100) -> tuple[DataFrame, int]:
    """(left, right, score, round of an assignment with each left and right once at most; the number of rounds).

    pairs: left, right, score.  It equals taking pairs one by one in the order (score descending,
    left, right) and leaving out those whose left or right is taken: in each round every pair that is
    the first of both its left and its right wins, and the pairs of winners go.  A round has
    one shuffle by left and one by right; what is left shrinks to the chains of rivals.
    """
    left = pairs.select("left", "right", "score").dropna().dropDuplicates(["left", "right"])
    left = cut(left.where(F.col("score") >= least) if least is not None else left)
    taken, n = [], 0
    while not left.isEmpty():
        if n == most:
            raise RuntimeError("assignment did not settle")
        n += 1
        order = F.struct(-F.col("score"), "left", "right")
        by_left = left.groupBy("left").agg(F.min_by("right", order).alias("right"), F.max("score").alias("score"))
        by_right = left.groupBy("right").agg(F.min_by("left", F.struct(-F.col("score"), "left")).alias("left"))
        won = cut(by_left.join(by_right, ["left", "right"]).select("left", "right", "score", F.lit(n).alias("round")))
        taken.append(won)
        left = cut(left.join(won.select("left"), "left", "left_anti").join(won.select("right"), "right", "left_anti").select("left", "right", "score"))
    out = taken[0] if taken else left.withColumn("round", F.lit(0))
    for t in taken[1:]:
        out = out.unionByName(t)
    return out, n


def settled_candidates(best: DataFrame, owned: DataFrame, least: float = 0.6, sure: float = 0.85) -> DataFrame:
    """ident, code, score, status of entities' best candidates, as if they were taken in the order of ident.

    best: ident, code, score (one row an ident); owned: ident, code that stand already.  A score under
    ``least`` is ``none``.  A code that another ident owns, or that an earlier one was confirmed
    for, is a ``conflict``; a score of ``sure`` confirms and owns the code, else it is a ``candidate``.
    An ident that owns a code itself isn't in the way of itself.
    """
    others = owned.groupBy("code").agg(F.min("ident").alias("__low"), F.max("ident").alias("__high"))
    rows = best.join(others, "code", "left")
    held = F.col("__low").isNotNull() & ((F.col("__low") != F.col("ident")) | (F.col("__high") != F.col("ident")))
    rows = rows.withColumn("__held", held).withColumn("__sure", (F.col("score") >= sure) & ~F.col("__held"))
    first = F.min(F.when(F.col("__sure"), F.col("ident"))).over(Window.partitionBy("code"))
    rows = rows.withColumn("__first", first)
    status = (
        F.when(F.col("score") < least, "none")
        .when(F.col("__held") | F.coalesce(F.col("__first") < F.col("ident"), F.lit(False)), "conflict")
        .when(F.col("score") >= sure, "confirmed")
        .otherwise("candidate")
    )
    return rows.select("ident", "code", "score", status.alias("status"))
