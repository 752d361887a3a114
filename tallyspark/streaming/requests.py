"""Request budgets, throttling and idempotent ingestion over event streams (batch or streaming frames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def budget(events: DataFrame, ts: str, capacity: int, window: str = "60 seconds", slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, used, remaining (0 at least) of each time window; ``late`` sets a watermark on a stream."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late and events.isStreaming else events
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = e.groupBy(w.alias("w")).agg(F.count("*").alias("used"))
    return out.select(F.col("w.start").alias("window_start"), "used", F.greatest(F.lit(capacity) - F.col("used"), F.lit(0)).alias("remaining"))


def throttled(events: DataFrame, key: str, ts: str, ident: str, seconds: int = 600) -> DataFrame:
    """Adds throttled: the same key came within the window before (batch frames)."""
    w = Window.partitionBy(key).orderBy(ts, ident)
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    return events.withColumn("throttled", F.coalesce(gap < seconds, F.lit(False)))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "10 minutes") -> DataFrame:
    """key, started, n: runs of events with no longer gap."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")


def once(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key's events once, within the watermark on a stream."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def rolling_budget(events: DataFrame, ts: str, ident: str, capacity: int, seconds: int = 60) -> DataFrame:
    """ident, ts, used, remaining: events from ``seconds`` before each event up to it, both ends included, and what is left.

    Events of one time count once each, whatever their order.  Times are dealt to stretches of the
    window's length, each with the counts of the one before, so no task holds all events; a burst
    is one count for each different time.  A count comes at its time and is taken off again a window
    later, so a stretch is one running sum, however many times lie within a window.
    """
    width = seconds * 1_000_000
    at = events.select(F.col(ident), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("__at")).withColumn("__b", F.floor(F.col("__at") / width))
    counts = at.groupBy("__b", "__at").agg(F.count("*").alias("__n"))
    # of the stretch before, all counts stand from the start (__at null), and go when they leave the window
    old = counts.withColumn("__b", F.col("__b") + 1)
    carried = old.groupBy("__b").agg(F.sum("__n").alias("__n")).select("__b", F.lit(None).cast("long").alias("__at"), "__n")
    leaving = old.select("__b", (F.col("__at") + width + 1).alias("__at"), (-F.col("__n")).alias("__n"))
    steps = counts.select("*", F.lit(True).alias("__own")).unionByName(carried.unionByName(leaving).withColumn("__own", F.lit(False)))
    w = Window.partitionBy("__b").orderBy(F.col("__at").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    used = steps.withColumn("used", F.sum("__n").over(w)).where("__own").select("__b", "__at", "used")
    return at.join(used, ["__b", "__at"]).select(ident, ts, "used", F.greatest(F.lit(capacity) - F.col("used"), F.lit(0)).alias("remaining"))
