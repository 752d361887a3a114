"""Derived metrics from long fact tables: ratios, owner's earnings and the nine-signal score.

facts: stock, metric_key, period_end, value (and fact_id, period_type where asked).  Each reads
the facts in one pivoting aggregate, one shuffle by (stock, period_end), not a join per metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import numbers as N

# fixed values: output -> (numerators, first that is there; denominators, added)
RATIOS = {
    "returns.roa": (["is.net_income"], ["bs.total_assets"]),
    "liquidity.current_ratio": (["bs.current_assets"], ["bs.current_liabilities"]),
    "leverage.long_term_debt_to_assets": (["cap.long_term_debt"], ["bs.total_assets"]),
    "leverage.long_term_debt_to_capital": (["cap.long_term_debt"], ["cap.long_term_debt", "bs.total_equity"]),
    "efficiency.asset_turnover": (["is.sales"], ["bs.total_assets"]),
    "efficiency.capital_turnover": (["is.sales"], ["cap.long_term_debt", "bs.total_equity"]),
    "ins.premium_turnover": (["is.net_premiums_earned", "is.pc_premiums_earned", "ins.premium_income"], ["bs.total_assets"]),
}


def wide(facts: DataFrame, keys: list[str]) -> DataFrame:
    """stock, period_end and a column for each metric key: the value of the highest fact_id."""
    pick = [F.max_by("value", F.when(F.col("metric_key") == k, F.col("fact_id"))).alias(k) for k in keys]
    return facts.where(F.col("metric_key").isin(keys)).groupBy("stock", "period_end").agg(*pick)


def c(key: str) -> Column:
    return F.col(f"`{key}`")


def long(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """stock, period_end, metric_key, value for every value that is there."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric_key"), v.cast("double").alias("value")) for k, v in values.items()])
    return df.select("stock", "period_end", F.inline(F.filter(pairs, lambda x: x["value"].isNotNull())))


def ratios(facts: DataFrame) -> DataFrame:
    """The derived ratios; one is left out where an input is missing or its denominator isn't positive."""
    keys = sorted({k for a, b in RATIOS.values() for k in a + b})
    out = {}
    for name, (top, below) in RATIOS.items():
        den = sum((c(k) for k in below[1:]), c(below[0]))
        out[name] = N.ratio(F.coalesce(*[c(k) for k in top]), den)
    return long(wide(facts, keys), out)


def owner_earnings(facts: DataFrame) -> DataFrame:
    """EPS + depreciation / shares - capital spending per share; missing inputs are 0, shares of 0 or less give no depreciation."""
    keys = ["per_share.eps", "per_share.capital_spending", "is.depreciation", "equity.shares_outstanding"]
    zero = lambda k: F.coalesce(c(k), F.lit(0.0))
    dep = F.when(zero(keys[3]) > 0, zero(keys[2]) / zero(keys[3])).otherwise(0.0)
    return wide(facts, keys).select("stock", "period_end", (zero(keys[0]) + dep - zero(keys[1])).alias("value"))


def normalized(earnings: DataFrame, years: int = 5) -> DataFrame:
    """stock, value: the median of the newest ``years`` values."""
    w = Window.partitionBy("stock").orderBy(F.desc("period_end"))
    return earnings.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= years).groupBy("stock").agg(F.median("value").alias("value"))


def median_element(df: DataFrame, key: str, value: str, day: str) -> DataFrame:
    """The row at place n // 2 of each key's values in order (ties by day): a row, not an average."""
    w = Window.partitionBy(key)
    place = F.row_number().over(w.orderBy(value, day))
    return df.withColumn("__p", place).withColumn("__n", F.count("*").over(w)).where(F.col("__p") == F.floor(F.col("__n") / 2) + 1).drop("__p", "__n")


# fixed values: component -> candidates in order: (test, metric keys, variant)
COMPONENTS = {
    "roa_positive": [("positive", ["returns.roa"], "standard"), ("positive", ["returns.total_capital"], "proxy"), ("positive", ["is.net_income"], "proxy")],
    "cfo_positive": [("positive", ["is.operating_cash_flow"], "standard"), ("positive", ["per_share.cash_flow"], "proxy")],
    "roa_improving": [("up", ["returns.roa"], "standard"), ("up", ["returns.total_capital"], "proxy")],
    "accrual_quality": [("above", ["is.operating_cash_flow", "is.net_income"], "standard"), ("above", ["per_share.cash_flow", "per_share.eps"], "proxy")],
    "leverage_declining": [("down", ["leverage.long_term_debt_to_assets"], "standard"), ("down", ["leverage.long_term_debt_to_capital"], "proxy"), ("down", ["cap.long_term_debt"], "proxy")],
    "current_ratio_improving": [("up", ["liquidity.current_ratio"], "standard"), ("ratio_up", ["bs.current_assets", "bs.current_liabilities"], "standard")],
    "no_dilution": [("not_up", ["equity.shares_outstanding"], "standard")],
    "gross_margin_improving": [("up", ["is.gross_margin"], "standard"), ("up_insurance", ["ins.underwriting_margin"], "insurance_adjusted"), ("up", ["is.operating_margin"], "proxy")],
    "asset_turnover_improving": [("up", ["efficiency.asset_turnover"], "standard"), ("up_insurance", ["ins.premium_turnover"], "proxy"), ("up_other", ["efficiency.capital_turnover"], "proxy")],
}


def score_components(facts: DataFrame) -> DataFrame:
    """stock, period_end and a struct(score, variant, method) per component, null where no candidate has its inputs.

    Years are compared with the stock's previous available one.
    """
    keys = sorted({k for cs in COMPONENTS.values() for _, ks, _ in cs for k in ks})
    w = Window.partitionBy("stock").orderBy("period_end")
    insurer = facts.groupBy("stock").agg(F.coalesce(F.bool_or(F.col("metric_key").startswith("ins.")), F.lit(False)).alias("insurer"))
    t = wide(facts, keys).join(insurer, "stock")
    t = t.select("*", *[F.lag(c(k)).over(w).alias(f"{k}<") for k in keys])
    was = lambda k: c(f"{k}<")

    def test(kind: str, ks: list[str]) -> Column:
        a = ks[0]
        if kind == "positive":
            return c(a) > 0
        if kind == "above":
            return c(a) > c(ks[1])
        if kind == "down":
            return c(a) < was(a)
        if kind == "not_up":
            return c(a) <= was(a)
        if kind == "ratio_up":
            return N.ratio(c(a), c(ks[1])) > N.ratio(was(a), was(ks[1]))
        up = c(a) > was(a)
        return up if kind == "up" else F.when(F.col("insurer") == F.lit(kind == "up_insurance"), up)

    def struct(kind: str, ks: list[str], variant: str) -> Column:
        hit = test(kind, ks)
        return F.when(hit.isNotNull(), F.struct(hit.cast("long").alias("score"), F.lit(variant).alias("variant"), F.lit(ks[0]).alias("method")))

    return t.select("stock", "period_end", "insurer", *[F.coalesce(*[struct(*x) for x in cs]).alias(name) for name, cs in COMPONENTS.items()])


def score_totals(components: DataFrame) -> DataFrame:
    """stock, period_end, status, total (all nine there) or partial, available, missing and variant."""
    parts = F.array(*[F.col(n) for n in COMPONENTS])
    there = F.filter(parts, lambda x: x.isNotNull())
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in COMPONENTS]))
    score = F.aggregate(there, F.lit(0).cast("long"), lambda a, x: a + x["score"])
    adjusted = F.col("insurer") | F.exists(there, lambda x: x["variant"] == "insurance_adjusted")
    variant = F.when(adjusted, "insurance_adjusted").when(F.forall(there, lambda x: x["variant"] == "standard"), "standard").otherwise("proxy")
    t = components.select("stock", "period_end", score.alias("score"), F.size(there).cast("long").alias("available"), missing.alias("missing"), variant.alias("variant"))
    full = F.size("missing") == 0
    return t.where("available > 0").select("stock", "period_end", F.when(full, "calculated").otherwise("partial").alias("status"), F.when(full, F.col("score")).alias("total"), F.when(~full, F.col("score")).alias("partial_score"), "available", "missing", "variant")
