"""Latest-wins, version, as-of and streak operators over keyed history tables.

Each takes its keys and its full tie-break order; rows are ranked within a key by a window, which
Spark cuts to one row a key and task before the shuffle where only the first is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in this order."""
    return ranked(df, keys, order, "__rn").where(F.col("__rn") <= n).drop("__rn")


def slot_winner(facts: DataFrame, slot: Sequence[str], report_date: str, document: str, fact: str, manual: str | None = None) -> DataFrame:
    """Adds is_current: the newest report wins its slot, a missing date loses; a manual current row retires all parsed ones."""
    w = Window.partitionBy(*slot)
    first = F.row_number().over(w.orderBy(F.col(report_date).desc_nulls_last(), F.col(document).desc_nulls_last(), F.col(fact).desc())) == 1
    if manual is None:
        return facts.withColumn("is_current", first)
    held = F.max(F.col(manual).cast("int")).over(w) == 1
    return facts.withColumn("is_current", F.when(held, F.col(manual)).otherwise(first))


def versions(filings: DataFrame, slot: Sequence[str], filed: str, key: str) -> DataFrame:
    """Adds version_rank, is_latest, previous_key and latest_key of each slot, in filing order."""
    w = Window.partitionBy(*slot).orderBy(filed, key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return filings.select(
        "*",
        F.row_number().over(w).cast("long").alias("version_rank"),
        (F.row_number().over(w) == F.count("*").over(Window.partitionBy(*slot))).alias("is_latest"),
        F.lag(key).over(w).alias("previous_key"),
        F.last(key).over(whole).alias("latest_key"),
    )


def as_of(prices: DataFrame, key: str, day: str, ties: Sequence[str], until: Column, values: Sequence[str], strict: bool = False) -> DataFrame:
    """One row a key: the values of the newest day up to ``until`` (before it, if strict)."""
    keep = F.col(day) < until if strict else F.col(day) <= until
    top = F.max_by(F.struct(day, *values), F.struct(day, *ties)).alias("x")
    return prices.where(keep).groupBy(key).agg(top).select(key, *[F.col(f"x.{c}").alias(c) for c in (day, *values)])


def exact_or_latest(prices: DataFrame, key: str, day: str, ties: Sequence[str], target: Column, value: str) -> DataFrame:
    """The value of the target day, else that of the newest day at all; both in one aggregate."""
    order = F.struct(day, *ties)
    exact = F.max_by(F.when(F.col(day) == target, F.col(value)), F.when(F.col(day) == target, order))
    return prices.groupBy(key).agg(F.coalesce(exact, F.max_by(value, order)).alias(value), F.coalesce(F.bool_or(F.col(day) == target), F.lit(False)).alias("exact"))


def period_index(periods: DataFrame, period: str) -> DataFrame:
    """period, idx: dense numbers of the distinct periods, oldest 1 (a few rows: one per period)."""
    return periods.select(period).distinct().withColumn("idx", F.row_number().over(Window.orderBy(period)).cast("long"))


def streaks(held: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """keys, period, streak: consecutive *available* periods that end at each held period."""
    rows = held.select(*keys, period).distinct().join(period_index(held, period), period)
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = rows.withColumn("island", F.col("idx") - F.row_number().over(w))
    return rows.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "island").orderBy("idx")).cast("long")).select(*keys, period, "streak")


def calendar_depth(periods: DataFrame, period: str, limit: int = 12) -> DataFrame:
    """depth: calendar quarters without a gap back from the newest one, at most ``limit``."""
    q = periods.select((F.year(period) * 4 + F.quarter(period)).alias("q")).distinct()
    q = q.withColumn("back", F.row_number().over(Window.orderBy(F.desc("q"))) - 1).withColumn("newest", F.max("q").over(Window.partitionBy()))
    return q.where(F.col("newest") - F.col("q") == F.col("back")).agg(F.least(F.count("*"), F.lit(limit)).cast("long").alias("depth"))


def upsert(table: DataFrame, news: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Both tables' rows, the newest of each key (news win ties)."""
    both = table.withColumn("__new", F.lit(0)).unionByName(news.withColumn("__new", F.lit(1)))
    return first_per_key(both, keys, [F.desc(order), F.desc("__new")]).drop("__new")


def insert_if_absent(table: DataFrame, news: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.unionByName(news.dropDuplicates(list(keys)).join(table, list(keys), "left_anti").select(*table.columns))


def placed(rows: DataFrame, value: str, ident: str) -> DataFrame:
    """Adds place: 1 for the greatest value, ties by ident, nulls last; no task holds all rows.

    A sort over all tasks numbers the rows of each; the sorted rows are checkpointed, so that the counts of
    the tasks before (a short array, one entry a task) and the numbers are of the same sort.
    """
    from .rounds import cut

    task, mask = F.shiftright("__m", 33), F.lit((1 << 33) - 1)
    dealt = cut(rows.orderBy(F.desc_nulls_last(value), ident).withColumn("__m", F.monotonically_increasing_id()))
    sizes = dealt.groupBy(task.alias("p")).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("p", "n")).alias("__sizes"))
    before = F.aggregate(F.filter("__sizes", lambda x: x["p"] < task), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return dealt.join(F.broadcast(sizes), F.lit(True)).withColumn("place", before + F.col("__m").bitwiseAND(mask) + 1).drop("__m", "__sizes")


def version_number(version: Column) -> Column:
    """The digits at a version's end as a number, -1 without any."""
    return F.coalesce(F.regexp_extract(F.coalesce(version, F.lit("")), r"(\d+)$", 1).try_cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)"))


def newest_version(rows: DataFrame, keys: Sequence[str], version: str, ident: str) -> DataFrame:
    """The row of each key with the greatest version number (v10 after v9), then ident."""
    return first_per_key(rows, keys, [version_number(F.col(version)).desc(), F.desc(ident)])
