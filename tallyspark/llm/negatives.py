"""Hard negatives by ball-tree branch and bound, exact over integer inner products.

Rows are sorted by label over all tasks and cut into slices of ``SLICE`` rows; a task
builds one ball tree of each slice (pure in labels near the top, then halved along the
widest direction).  Anchors are cut into blocks of ``BLOCK`` rows.  Every block meets every
tree that can hold an answer, as pairs of bounded size: a search of a stated query set against
all rows, in blocks.  Blocks are sent once to each of a fixed number of slots, which hold the
trees; a pair costs one matrix product a leaf at most, for the anchors that are left.

For a node with centre c and radius r, an anchor a has every inner product in it within
a.c - |a| r and a.c + |a| r.  ``nearest`` drops nodes strictly beneath the current kth
score, of other labels, or both; ``in_window`` also drops those outside the score window on
either side.  Ties stand, so the result is exact; each tree's few best are then merged.

Scores are exact: a pair uses float64 products only while their sums stay under 2**53,
else Python's integers.  Pairs whose score a long cannot hold are left out.  Vectors of
different lengths have no score and never meet.  Rows with a null vec_id, label or vector,
or a null or non-finite component take no part; a component is floor(256 * x).  Each row of a
repeated vec_id counts as a row of its own, and each such anchor gets its rows.  An empty
vector scores 0.  An empty table, or one without anchors, gives no rows.  Further columns, of
any name, are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

SLICE, BLOCK, LEAF = 8192, 512, 64
#: scores are packed with a row's place in its slice into one sort key
_NONE = np.iinfo(np.int64).max
_EXACT = float(1 << 49)


def prepared(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """row, vec_id, label, dims, vector (doubles with whole values) of the rows that take part."""
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), (label if label is not None else F.col("label")).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # floor() gives a long; doubles from 2**53 on are whole
    whole = F.transform("x", lambda c: F.when(F.abs(c) < float(1 << 45), F.floor(c * 256.0).cast("double")).otherwise(c * 256.0))
    fine = fine & F.forall("x", lambda c: F.abs(c * 256.0) != float("inf"))
    kept = given.where("vec_id is not null and label is not null and x is not null").where(fine)
    return written(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("x").alias("dims"), whole.alias("vector")))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return {k: f[k] for k in f.files}


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole doubles in the smallest type that holds them."""
    top = np.abs(x).max(initial=0)
    return x.astype(np.int16) if top < 1 << 15 else x.astype(np.int32) if top < 1 << 31 else x


def ball_tree(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Nodes in depth-first order: begin and end in ``order``, skip (the node after the subtree), centre, radius, labels' range."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x))]
    while todo:
        b, e = todo.pop()
        ids = order[b:e]
        pts, lab = x[ids], labels[ids]
        centre = pts.mean(axis=0)
        radius = float(np.sqrt(((pts - centre) ** 2).sum(axis=1).max()))
        nodes.append((b, e, radius, lab.min(), lab.max(), centre))
        if e - b <= leaf:
            continue
        if lab.min() != lab.max():
            by = np.sort(lab)
            at = int(np.searchsorted(by, by[(e - b) // 2]))  # a border between labels
            at = at or int(np.searchsorted(by, by[0], "right"))
            ids = ids[np.argsort(lab, kind="stable")]
        else:
            far = pts[((pts - centre) ** 2).sum(axis=1).argmax()] - centre
            ids, at = ids[np.argsort(pts @ far, kind="stable")], (e - b) // 2
        order[b:e] = ids
        todo += [(b + at, e), (b, b + at)]
    begin, end = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
    skip, stack = np.full(len(nodes), len(nodes)), []
    for i, e in enumerate(end):  # in depth-first order a subtree ends before the first later node that begins at its end
        while stack and end[stack[-1]] <= begin[i]:
            skip[stack.pop()] = i
        stack.append(i)
    return {"order": order, "begin": begin, "end": end, "skip": skip, "radius": np.array([n[2] for n in nodes]), "low": np.array([n[3] for n in nodes]), "high": np.array([n[4] for n in nodes]), "centre": np.array([n[5] for n in nodes])}


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), dims)


def _sliced(rows: DataFrame, size: int, build, schema: str, by: list) -> DataFrame:
    """build(dims, batch) over slices of the sorted rows, each of one number of dims."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, dims = [], 0, None

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            return build(dims, table.to_batches()[0])

        for b in batches:
            lengths = b.column("dims").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                while s < e:
                    if held and (dims != int(lengths[s]) or n == size):
                        yield flush()
                        held, n = [], 0
                    dims, take = int(lengths[s]), min(e - s, size - n)
                    held.append(b.slice(s, take))
                    n, s = n + take, s + take
        if held:
            yield flush()

    conf = rows.sparkSession.conf
    n = max(int(conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(task, schema)


def trees(rows: DataFrame, size: int = SLICE) -> DataFrame:
    """low, high (labels), dims, tree of every slice."""

    def build(dims: int, b: pa.RecordBatch) -> pa.RecordBatch:
        x, ids, labels = _matrix(b.column("vector"), dims), b.column("vec_id").to_numpy(), b.column("label").to_numpy()
        t = ball_tree(x, labels)
        order = t.pop("order")
        place = np.empty(len(ids), np.int64)  # by vec_id, then the rest, so that ties don't depend on tasks
        place[np.lexsort((b.column("row").to_numpy(), ids))] = np.arange(len(ids))
        raw = _packed(**t, x=_narrow(x[order]), row=b.column("row").to_numpy()[order], vec_id=ids[order], label=labels[order], place=place[order])
        return pa.record_batch([pa.array([int(labels.min())]), pa.array([int(labels.max())]), pa.array([dims], pa.int32()), pa.array([raw], pa.binary())], names=["low", "high", "dims", "tree"])

    return _sliced(rows, size, build, "low long, high long, dims int, tree binary", ["dims", "label", "vec_id", "row"])


def blocks(queries: DataFrame, size: int = BLOCK, positives: bool = False) -> DataFrame:
    """low, high (labels), dims, block of every slice of the queries; with their positives if they have some."""

    def build(dims: int, b: pa.RecordBatch) -> pa.RecordBatch:
        labels = b.column("label").to_numpy()
        more = {}
        if positives:
            lists = b.column("scores")
            more = {"of": np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), "score": lists.flatten().to_numpy()}
        raw = _packed(x=_narrow(_matrix(b.column("vector"), dims)), row=b.column("row").to_numpy(), label=labels, **more)
        return pa.record_batch([pa.array([int(labels.min())]), pa.array([int(labels.max())]), pa.array([dims], pa.int32()), pa.array([raw], pa.binary())], names=["low", "high", "dims", "block"])

    return _sliced(queries, size, build, "low long, high long, dims int, block binary", ["dims", "label", "row"])


def _pairs(tree_rows: DataFrame, block_rows: DataFrame, slots: int, same: bool) -> DataFrame:
    """tree, block: each tree with each block it can answer; a block goes once to each slot of trees.

    Trees of repeated vectors are many times larger than the file they are in, which is what Spark
    would judge by, so neither side may go through the driver.
    """
    t = tree_rows.select("dims", F.col("low").alias("t_low"), F.col("high").alias("t_high"), "tree", F.pmod(F.xxhash64("tree"), F.lit(slots)).cast("int").alias("slot"))
    b = block_rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    meet = (F.col("t_low") <= F.col("high")) & (F.col("t_high") >= F.col("low")) if same else ~((F.col("t_low") == F.col("t_high")) & (F.col("low") == F.col("high")) & (F.col("t_low") == F.col("low")))
    return t.hint("merge").join(b, ["slot", "dims"]).where(meet).select("tree", "block")


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products, as int64 where they stay under 2**49, else as Python integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(a.astype(np.float64)) @ whole(x.astype(np.float64)).T if a.shape[1] else np.zeros((len(a), len(x)), np.int64)


def search(t: dict, a: np.ndarray, labels: np.ndarray, rows: np.ndarray, k: int, of: np.ndarray, same: bool, score: np.ndarray | None = None, window: tuple[int, int, int] = (50, 95, 100)) -> tuple[np.ndarray, np.ndarray, list]:
    """(query, place in the tree's rows, score) of each query's k best; query i asks for anchor of[i].

    same: rows of the anchor's label but the anchor itself; else rows of other labels.  With score,
    only those with window[0] * score <= window[2] * s <= window[1] * score.
    """
    size, n = len(t["vec_id"]), len(of)
    top = float(np.abs(a).max(initial=0)) * float(np.abs(t["x"]).max(initial=0)) * max(a.shape[1], 1)
    big = top >= _EXACT or size > 1 << 13
    kind = object if big else np.int64
    none = (1 << 2200) if big else _NONE
    best = np.full((n, k), none, dtype=kind)
    a64, norm = a.astype(np.float64), np.sqrt((a.astype(np.float64) ** 2).sum(axis=1))
    middle, reach = a64 @ t["centre"].T, norm[:, None] * t["radius"][None, :]
    slack = 1e-9 * (np.abs(middle) + reach + top) + 1
    upper, lower = middle + reach + slack, middle - reach - slack
    unsure = ~(np.isfinite(upper) & np.isfinite(lower))  # of components near the largest double
    upper[unsure], lower[unsure] = np.inf, -np.inf
    if score is not None:
        low, high = score.astype(np.float64) * window[0] / window[2], score.astype(np.float64) * window[1] / window[2]
        edge = 1e-9 * np.abs(score.astype(np.float64)) + 1
    i, total = 0, len(t["begin"])
    scale = max(size, 1)
    while i < total:
        kth = np.where(best[:, k - 1] == none, -np.inf, -np.floor_divide(best[:, k - 1], scale).astype(np.float64)) if not big else np.array([-np.inf if b == none else float(-(b // scale)) for b in best[:, k - 1]])
        up = upper[of, i]
        alive = up >= kth
        if same:
            alive &= (t["low"][i] <= labels[of]) & (labels[of] <= t["high"][i])
        else:
            alive &= ~((t["low"][i] == t["high"][i]) & (t["low"][i] == labels[of]))
        if score is not None:
            alive &= (up >= low - edge) & (lower[of, i] <= high + edge)
        if not alive.any():
            i = int(t["skip"][i])
            continue
        if t["skip"][i] == i + 1:  # a leaf
            b, e = int(t["begin"][i]), int(t["end"][i])
            q = np.flatnonzero(alive)
            anchors, at = np.unique(of[q], return_inverse=True)
            s = _products(a[anchors], t["x"][b:e]).astype(kind)[at]
            ok = (t["label"][None, b:e] == labels[of[q]][:, None]) == same
            if same:
                ok &= t["row"][None, b:e] != rows[of[q]][:, None]
            if score is not None:
                own = score[q].astype(kind)[:, None]
                ok &= ((window[0] * own <= window[2] * s) & (window[2] * s <= window[1] * own)).astype(bool)
            keys = np.where(ok, -s * scale + t["place"][None, b:e].astype(kind), none)
            both = np.concatenate([best[q], keys], axis=1)
            best[q] = np.sort(both if big or both.shape[1] <= k else np.partition(both, k - 1, axis=1)[:, :k], axis=1)[:, :k]
        i += 1
    q, j = np.nonzero(best != none)
    keys = best[q, j]
    by_place = np.argsort(t["place"])
    return q, by_place[(keys % scale).astype(np.int64)], [-int(x // scale) for x in keys]


def _long(scores: list[int]) -> pa.Array:
    return pa.array([s if -(1 << 63) <= s < 1 << 63 else None for s in scores], pa.int64())


def nearest(tree_rows: DataFrame, queries: DataFrame, k: int, slots: int) -> DataFrame:
    """anchor (its row), row, vec_id, score, rank: the k best other rows of the anchor's label."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, q in zip(b.column(0), b.column(1)):
                t, q = _unpacked(t.as_py()), _unpacked(q.as_py())
                of, at, score = search(t, q["x"], q["label"], q["row"], k, np.arange(len(q["row"])), True)
                yield pa.record_batch([pa.array(q["row"][of]), pa.array(t["row"][at]), pa.array(t["vec_id"][at]), _long(score)], names=["anchor", "row", "vec_id", "score"])

    found = _pairs(tree_rows, blocks(queries), slots, True).mapInArrow(task, "anchor long, row long, vec_id long, score long").where("score is not null")
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def in_window(tree_rows: DataFrame, queries: DataFrame, k: int, window: tuple[int, int, int], slots: int) -> DataFrame:
    """anchor, positive_score, negative_id, score, rank: the k best rows of other labels in the window of each distinct score of an anchor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, q in zip(b.column(0), b.column(1)):
                t, q = _unpacked(t.as_py()), _unpacked(q.as_py())
                i, at, score = search(t, q["x"], q["label"], q["row"], k, q["of"], False, q["score"], window)
                yield pa.record_batch([pa.array(q["row"][q["of"][i]]), pa.array(q["score"][i]), pa.array(t["row"][at]), pa.array(t["vec_id"][at]), _long(score)], names=["anchor", "positive_score", "row", "negative_id", "score"])

    found = _pairs(tree_rows, blocks(queries, positives=True), slots, False).mapInArrow(task, "anchor long, positive_score long, row long, negative_id long, score long").where("score is not null")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "negative_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, label: Column | None = None, n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int, int] = (50, 95, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors tells which rows are anchors (over vec_id and label); label replaces the rows' own.
    An anchor's positives are its n_positives best other rows of its label; each gets the
    n_negatives best rows of other labels with window[0] * positive <= window[2] * negative
    <= window[1] * positive (scores).  Better scores come first, ties by vec_id.
    """
    base = prepared(rows, label)
    spark = base.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    forest, asked = written(trees(base)), base.where(anchors)
    positives = written(nearest(forest, asked, n_positives, slots))
    # at most n_positives scores stand in a list
    scores = positives.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_set("score")).alias("scores"))
    negatives = in_window(forest, asked.hint("merge").join(scores, "row"), n_negatives, window, slots)
    ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = positives.select("anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.select("anchor", "positive_score", "negative_id", F.col("score").alias("negative_score"), "rank").join(pairs.hint("merge"), ["anchor", "positive_score"]).join(ids.hint("merge"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
