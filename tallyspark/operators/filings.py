"""Filing quality checks, coverage, progress, readiness ladders and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(check: str, severity: str, found: DataFrame, subject: str, detail: str) -> DataFrame:
    return found.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"), F.col(detail).cast("string").alias("detail"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count n."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def bad_codes(rows: DataFrame, code: str, pattern: str = "^[A-Z0-9]{9}$", limit: int = 20) -> DataFrame:
    """The most frequent codes that don't match (a report of at most ``limit`` rows)."""
    return rows.where(~F.col(code).rlike(pattern)).groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), code).limit(limit)


def reconciliation(filings: DataFrame, rows: DataFrame, key: str, reported: str, value: str, tolerance: float = 0.001) -> DataFrame:
    """Filings whose summed rows differ from the reported total by more than the tolerance."""
    total = rows.groupBy(key).agg(F.sum(value).alias("computed"))
    both = filings.select(key, reported).join(total, key)
    gap = F.abs(F.col("computed") - F.col(reported)) / F.greatest(F.col(reported), F.lit(1.0))
    return both.where(gap > tolerance).select(key, F.col(reported).alias("reported"), "computed")


def negative(rows: DataFrame, inside: Column, corrected: bool = False) -> DataFrame:
    """Rows of negative shares or value.  As stated, the quarter bound holds for the value test only; ``corrected`` applies it to both."""
    a, b = F.col("shares") < 0, F.col("value") < 0
    return rows.where((a | b) & inside if corrected else a | (b & inside))


def either_key(docs: DataFrame, filings: DataFrame, doc: str, keys: tuple[str, str]) -> DataFrame:
    """doc rows that a filing names by either of two keys, once per filing: two equi-joins' worth in one, no nested loop."""
    named = filings.select("filing", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias(doc))
    return docs.join(named, doc)


def status_counts(df: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """A row per key with a count per status, 0 where there is none."""
    return df.groupBy(key).pivot(status, values).agg(F.count(F.lit(1))).fillna(0)


def report(all_issues: DataFrame, checks: list[str]) -> DataFrame:
    """errors, warnings, infos (passing checks) and status over an issues table; one row."""
    n = lambda s: F.count_if(F.col("severity") == s)
    out = all_issues.agg(n("error").alias("errors"), n("warning").alias("warnings"), (F.lit(len(checks)) - F.count_distinct("check")).alias("infos"))
    return out.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed"))


def progress(managers: DataFrame, filings: DataFrame) -> DataFrame:
    """Every manager with filed or pending, the newest filing and their number; filings: manager, filed_at, filing."""
    latest = filings.groupBy("manager").agg(F.max_by("filing", F.struct("filed_at", "filing")).alias("filing"), F.count("*").alias("n"))
    return managers.join(latest, "manager", "left").select("manager", F.when(F.col("filing").isNotNull(), "filed").otherwise("pending").alias("status"), "filing", F.coalesce("n", F.lit(0)).alias("n"))


def readiness_level(managers: Column, holdings: Column, amendments: Column, linked: Column, depth: Column) -> Column:
    return (
        F.when((managers == 0) | (holdings == 0), "unavailable")
        .when(amendments.isin("amendments_pending", "amendment_failed") | linked.isNull() | (linked < 0.5) | (depth < 2), "experimental")
        .when((linked < 0.8) | (depth < 4), "usable_with_warning")
        .otherwise("ready")
    )


def frontend_behavior(level: Column, holdings_partial: Column) -> Column:
    return F.when(level.isin("unavailable", "experimental"), "show_setup_required").when(level == "ready", "normal").when(holdings_partial, "show_with_partial_warning").otherwise("show_with_warning")


def capabilities(depth: Column) -> Column:
    """What so many quarters of history allow, as an array."""
    steps = [(1, ["snapshot"]), (2, ["position_changes"]), (4, ["annual_trend", "holding_streak"]), (8, ["cyclical_patterns"])]
    return F.flatten(F.array_compact(F.array(*[F.when(depth >= n, F.array(*map(F.lit, names))) for n, names in steps])))


def quarter_health(s: dict[str, Column]) -> Column:
    """The ordered ladder over a quarter's counts and flags (keys as named below)."""
    none = ~s["index_fetched"] & (s["filings"] == 0)
    return (
        F.when(s["managers"] == 0, "setup_required")
        .when(s["revoked"], "needs_review")
        .when(s["failed"] > 0, "failed")
        .when(s["amendments"].isin("amendments_pending", "amendment_failed"), "needs_review")
        .when(s["quality"].isin("failed", "warning"), "needs_review")
        .when(s["active_job"], "ingesting")
        .when((s["phase"] == "post_deadline") & none & s["prior_data"], "stale")
        .when(none & (s["phase"] == "post_deadline"), "not_started")
        .when(none, "partial")
        .when(s["index_fetched"] & (s["filings"] == 0), "index_fetched")
        .when(s["holdings"] == 0, "partial")
        .when(s["linked"] < 0.5, "needs_review")
        .when(s["phase"] == "filing_window_open", "partial")
        .otherwise("complete")
    )


def retries(jobs: DataFrame, now: Column, kinds: list[str], most: int = 3) -> DataFrame:
    """One failed job per lock key to try again: a day old, of these kinds, tried up to ``most`` times, its lock neither active nor done since.

    jobs: job, kind, lock_key, status, finished_at.
    """
    w = Window.partitionBy("lock_key")
    tried = F.count_if(F.col("status") == "failed").over(w)
    busy = F.max(F.col("status").isin("queued", "running", "succeeded").cast("int")).over(w) == 1
    old = F.unix_timestamp(now) - F.unix_timestamp("finished_at") >= 86400
    rows = jobs.withColumn("__tried", tried).withColumn("__busy", busy).where((F.col("status") == "failed") & ~F.col("__busy") & (F.col("__tried") <= most) & old & F.col("kind").isin(kinds))
    return rows.withColumn("__rn", F.row_number().over(w.orderBy(F.desc("finished_at"), F.desc("job")))).where("__rn = 1").select("job", "kind", "lock_key")
