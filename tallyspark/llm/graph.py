"""Connected components of a links table, a filter of numbers, and where intermediate results are kept."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbatch import mix, thrifty

#: the most bits of a filter
FILTER_BITS = 1 << 26
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for local sessions without it (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        folder = "file://" + tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of few megabytes, so that a Python worker's memory doesn't follow the rows' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The frame as a table in the shared folder, which cuts its lineage.

    Spark drops the frame's shuffle files as soon as the table stands, so that those of the steps
    before don't pile up on the executors' disks until the driver's next collection of garbage.
    """
    spark = small_batches(df.sparkSession)
    path = os.path.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    return spark.read.schema(df.schema).parquet(path)


def _bits_of(x: np.ndarray, bits: int) -> np.ndarray:
    x = np.asarray(x, np.int64).view(np.uint64)
    return np.stack([(mix(x + np.uint64(i)) % np.uint64(bits)).astype(np.int64) for i in (1, 2)])


def bit_filter(wanted: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A function for tasks that tells which numbers may be in the one column of wanted.

    It lets all of these pass, and others by chance.  It has about 16 bits, two of them set,
    for each, up to ``FILTER_BITS``; beyond that more others pass, which nothing asks for.
    """
    bits = min(FILTER_BITS, 1 << max(16, (16 * wanted.count()).bit_length()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = _bits_of(b.column(0).to_numpy(), bits).ravel()
            yield pa.record_batch([pa.array(bit >> 5), pa.array(np.int64(1) << (bit & 31))], names=["word", "mask"])

    out = np.zeros(bits // 32, np.uint32)
    got = wanted.mapInArrow(thrifty(task), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most bits / 32 rows
    out[got["word"].to_numpy()] = got["mask"].to_numpy().astype(np.uint32)
    shared = wanted.sparkSession.sparkContext.broadcast(out.tobytes())

    def passes(x: np.ndarray) -> np.ndarray:
        bit = _bits_of(x, bits)
        return ((np.frombuffer(shared.value, np.uint32)[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1).all(axis=0)

    return passes


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, root: the smallest node that each node of links (a, b) reaches.

    Each round, every node takes the smallest root among its neighbours' and its own,
    then the root of that root, so the number of rounds grows with the logarithm of a
    component's diameter.  Nodes without links aren't in the result.  A round's roots
    are written to the shared folder.
    """
    both = links.select("a", "b").where("a != b").distinct()
    edges = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(max_rounds):
        seen = edges.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        step = roots.join(seen, "node").select("node", "root", F.least("root", "r").alias("low"))
        # a root also hears of the low roots that its members have found
        told = step.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        step = step.join(told, "node", "left").select("node", "root", F.least("low", F.coalesce("told", "low")).alias("low"))
        up = step.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = written(step.join(up, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("root"), F.col("root").alias("was")))
        changed = new.where("root != was").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError("components did not settle")
