"""Entity matching: fuzzy names, validity intervals and code mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fuzzy(left: DataFrame, right: DataFrame, threshold: float, exact: bool = True) -> DataFrame:
    """l_id, r_id, score: each left name's best right name by token containment, at the threshold or above.

    An equal name wins outright; ties go to the smaller (name, id).  left: l_id, l_name; right:
    r_id, r_name (normalised).  Any positive score shares a token, so names meet in an equi-join
    on tokens.  A name pair that meets on a token is counted by its number of shared tokens, so the
    join carries ids and set sizes, never names.
    """
    tokens = lambda name: F.array_distinct(F.filter(F.split(name, r"\s+"), lambda t: F.length(t) > 1))
    # equal names share their fate: distinct names meet, ids follow
    ln = left.groupBy(F.col("l_name").alias("l")).agg(F.count("*").alias("__n")).select("l", tokens("l").alias("lt"))
    rn = right.groupBy(F.col("r_name").alias("r")).agg(F.min("r_id").alias("r_id")).select("r", "r_id", tokens("r").alias("rt"))
    met = ln.select("l", F.size("lt").alias("ls"), F.explode("lt").alias("token")).join(rn.select("r", "r_id", F.size("rt").alias("rs"), F.explode("rt").alias("token")), "token")
    scored = met.groupBy("l", "r", "r_id", "ls", "rs").agg(F.count("*").alias("both"))
    score = F.col("both") / F.least("ls", "rs")
    same = (F.col("l") == F.col("r")) if exact else F.lit(False)
    best = scored.withColumn("score", score).withColumn("same", same).where(F.col("same") | (F.col("score") >= threshold))
    # the smaller name wins a tie: struct maxima take the negated order by a window over each name's few candidates
    w = Window.partitionBy("l").orderBy(F.desc("same"), F.desc("score"), "r", "r_id")
    best = best.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    return left.join(best.select(F.col("l").alias("l_name"), "r_id", "score"), "l_name").select("l_id", "r_id", "score")


def overlaps(intervals: DataFrame, key: str, a: str, b: str, ident: str) -> DataFrame:
    """ident, other of intervals of one key that overlap (closed; null bounds are open).

    A sweep, not a self join: with intervals in order of start, an interval overlaps an earlier
    one exactly where the greatest end so far reaches its start; ``other`` is that earlier one.
    """
    low, high = F.coalesce(a, F.lit("0001-01-01").cast("date")), F.coalesce(b, F.lit("9999-12-31").cast("date"))
    rows = intervals.select(key, F.col(ident).alias("ident"), low.alias("lo"), high.alias("hi"))
    w = Window.partitionBy(key).orderBy("lo", "ident").rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.max(F.struct("hi", "ident")).over(w)
    return rows.withColumn("m", furthest).where(F.col("m.hi") >= F.col("lo")).select(key, "ident", F.col("m.ident").alias("other"))


def fill_from(rows: DataFrame, mapping: DataFrame, key: str, target: str, order: list[Column]) -> DataFrame:
    """rows with null targets filled from the mapping's first row per key."""
    w = Window.partitionBy(key).orderBy(*order)
    one = mapping.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(key, F.col(target).alias("__t"))
    return rows.join(one, key, "left").withColumn(target, F.coalesce(target, "__t")).drop("__t")


def most_common(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n: the most frequent value of each key, the smaller one on ties."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return counts.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


# fixed values, strongest last
CONFIDENCE = ["low", "medium", "high", "manual"]


def settle_mapping(mappings: DataFrame) -> DataFrame:
    """Adds is_active: of a code's mappings in order of arrival, one takes over only with a higher confidence than all before.

    mappings: code, ticker, confidence, seq.
    """
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    best = F.max_by("seq", F.struct(rank, -F.col("seq"))).over(Window.partitionBy("code"))
    return mappings.withColumn("is_active", F.col("seq") == best)


def whitelisted(records: DataFrame, allowed: DataFrame, key: str, known: DataFrame, ident: str) -> DataFrame:
    """Records of allowed keys that aren't known yet."""
    return records.join(allowed.select(key).distinct(), key, "left_semi").join(known.select(ident), ident, "left_anti")


def canonical(rows: DataFrame, name: str, group: str, ident: str) -> DataFrame:
    """Adds canonical_id and keeps: the least id of each (upper-cased name, group)."""
    w = Window.partitionBy(F.upper(name), group).orderBy(ident)
    return rows.select("*", F.first(ident).over(w).alias("canonical_id"), (F.row_number().over(w) == 1).alias("keeps"))
