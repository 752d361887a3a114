"""The driver's star tables read as holdings, filings, facts and prices."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """manager (supplier), stock (brand), period (quarter end of shipping), shares, value."""
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("stock"))
    period = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    rows = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("manager"), period.alias("period"), F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("value"))
    return rows.join(brands, "l_partkey").drop("l_partkey")


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """manager (customer), period (year), filed_at, filing (order), status, reported."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("manager"), F.year("o_orderdate").cast("long").alias("period"), F.col("o_orderdate").alias("filed_at"), F.col("o_orderkey").alias("filing"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("reported"))


#: metric key -> aggregate over a supplier's lines of a year, the same text for Spark and DuckDB
FACTS = {
    "is.sales": "sum(l_extendedprice)",
    "is.net_income": "sum(l_extendedprice * (l_discount - 0.04))",
    "is.operating_cash_flow": "sum(l_extendedprice * (l_tax - 0.03))",
    "bs.total_assets": "sum(l_extendedprice * (1 + l_tax))",
    "bs.total_equity": "sum(l_extendedprice * l_discount)",
    "bs.current_assets": "sum(case when l_returnflag = 'R' then l_extendedprice else 0 end)",
    "bs.current_liabilities": "sum(case when l_returnflag = 'A' then l_extendedprice else 0 end)",
    "cap.long_term_debt": "sum(case when l_linestatus = 'F' then l_extendedprice * 0.3 else 0 end)",
    "equity.shares_outstanding": "sum(l_quantity)",
    "is.depreciation": "sum(l_quantity * l_tax)",
    "per_share.eps": "avg(l_extendedprice) / 1000",
    "per_share.capital_spending": "avg(l_quantity)",
    "is.gross_margin": "avg(l_discount)",
    "val.pe": "avg(l_extendedprice) / avg(l_quantity) / 50",
    "val.dividend_yield": "avg(l_tax)",
}


#: numbers that are added exactly: fewer than this, of at most six decimals
_LARGE = 1e9
_ADDED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _exactly(fact: str) -> str:
    """The aggregate over decimals; averages are one division of whole millionths, so that equal ones give equal doubles."""
    fact = re.sub(rf"\b({'|'.join(_ADDED)})\b", r"__\1", fact)
    fact = re.sub(r"avg\((\w+)\)", r"(cast(sum(\1) * 1000000 as double) / count(\1) / 1000000)", fact)
    return f"cast({fact} as double)"


def facts(spark: SparkSession, sf: str, exact: bool = True) -> DataFrame:
    """stock (supplier), period_end (year end), metric_key, value, fact_id, period_type, nature, created.

    Sums are exact and don't depend on the order of rows, so values that tie also compare as equal; a group
    with a number of ``_LARGE`` or more, of more decimals, or that isn't finite has plain double sums, as all
    have if not ``exact``.
    """
    year = F.year("l_shipdate")
    lines = table(spark, sf, "lineitem")
    lines = lines.withColumns({f"__{c}": F.when(F.abs(c) < _LARGE, F.col(c)).try_cast("decimal(18,6)") for c in _ADDED})
    fine = F.bool_and(F.expr(" and ".join(f"{c} <=> cast(__{c} as double)" for c in _ADDED)))
    added = lambda e: F.when(fine, F.expr(_exactly(e))).otherwise(F.expr(e)) if exact else F.expr(e)
    rows = lines.groupBy(F.col("l_suppkey").alias("stock"), year.alias("year")).agg(*[added(e).alias(k) for k, e in FACTS.items()])
    long = rows.unpivot(["stock", "year"], [F.col(f"`{k}`") for k in FACTS], "metric_key", "value")
    end = F.make_date("year", F.lit(12), F.lit(31))
    return long.select("stock", end.alias("period_end"), "metric_key", "value", (F.col("stock") * 10000 + F.col("year")).alias("fact_id"), F.lit("FY").alias("period_type"), F.when(F.col("year") >= 2001, "estimate").otherwise("actual").alias("nature"), end.alias("created"))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """stock (user), day, close, event_id of every event."""
    return table(spark, sf, "events").select(F.col("user_id").alias("stock"), F.to_date("ts").alias("day"), F.col("value").alias("close"), "event_id")
