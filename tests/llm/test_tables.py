"""Intermediate tables."""

import time

from pyspark.sql import functions as F

from tallyspark.llm.graph import CLEAN_UP, written


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(CLEAN_UP, None)
    held = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    table = written(held)
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEAN_UP, None) == was
    assert {tuple(r) for r in table.collect()} == {(k, sum(range(k, 1000, 7))) for k in range(7)}
    assert held.count() == 7  # the frame itself can still be run
