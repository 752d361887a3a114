"""Guarded arithmetic, scores and closed forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonzero(c: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(c, F.lit(0.0))


def first_nonzero(a: Column, b: Column) -> Column:
    return F.coalesce(nonzero(a), b)


def ratio(num: Column, den: Column) -> Column:
    """num / den where den > 0, else null."""
    return F.when(den > 0, num / den)


def action(shares: Column, previous: Column) -> Column:
    """new, add (over +5 %), reduce (under -5 %) or flat; a previous count of 0 or less means add."""
    change = (shares - previous) / previous
    return F.when(previous.isNull(), "new").when(previous <= 0, "add").when(change > 0.05, "add").when(change < -0.05, "reduce").otherwise("flat")


def share_change(shares: Column, previous: Column) -> Column:
    return F.when(previous > 0, (shares - previous) / previous)


def position_signal(weight: Column, rank: Column, streak: Column, act: Column) -> Column:
    """min(4w, 1) + 0.4 in the top ten + 0.3 from 5 % on + 0.3 from four periods on, plus or minus the action; at least 0."""
    base = F.least(weight * 4, F.lit(1.0)) + F.when(rank <= 10, 0.4).otherwise(0.0) + F.when(weight >= 0.05, 0.3).otherwise(0.0) + F.when(streak >= 4, 0.3).otherwise(0.0)
    step = F.when(act.isin("new", "add"), 0.2).when(act == "reduce", -0.2).otherwise(0.0)
    return F.greatest(base + step, F.lit(0.0))


def manager_kind(turnover: Column, top_ten: Column, names: Column, streak: Column) -> Column:
    return F.when(turnover >= 0.6, "high_turnover").when((top_ten >= 0.5) & (names <= 25), "value_concentrated").when(streak >= 4, "long_term").otherwise("unknown")


def manager_weight(turnover: Column, top_ten: Column, names: Column, streak: Column) -> Column:
    return F.when(turnover >= 0.6, 0.3).when((top_ten >= 0.5) & (names <= 25), 1.0).when(streak >= 4, 1.0).otherwise(0.6)


def price_estimate(value: Column, shares: Column) -> Column:
    """Value (in full, not in thousands) over shares, where both are positive."""
    return F.when((shares > 0) & (value > 0), value / shares)


def margin_of_safety(fair: Column, price: Column) -> Column:
    return F.when(fair > 0, (fair - price) / fair)


def score_tone(score: Column) -> Column:
    return F.when(score >= 7, "strong").when(score >= 4, "mixed").when(score.isNotNull(), "weak")


def bubble_size(holders: Column) -> Column:
    return F.when(holders >= 10, "large").when(holders >= 5, "medium").otherwise("small")


def bounded_power(base: Column, exponent: Column) -> Column:
    """base ** exponent through logarithms, 0 or infinity beyond 700 in log space."""
    log = exponent * F.ln(F.when(base > 0, base))
    return F.when(base <= 0, F.lit(0.0)).when(log > 700, F.lit(float("inf"))).when(log < -700, F.lit(0.0)).otherwise(F.exp(log))


def whole_years(c: Column) -> Column:
    return F.greatest(F.floor(c).cast("double"), F.lit(0.0))


def growth_value(base: Column, discount: Column, years: Column, growth: Column) -> Column:
    """Present value of ``years`` growing payments; rates are fractions."""
    n, q = whole_years(years), (1 + growth) / (1 + discount)
    return F.when(F.abs(q - 1) < 1e-12, base * n).otherwise(base * q * (1 - bounded_power(q, n)) / (1 - q))


def terminal_value(base: Column, discount: Column, years: Column, growth: Column, later_years: Column, later_growth: Column) -> Column:
    """Present value of what follows ``years``: ``later_years`` payments growing at ``later_growth``."""
    n = whole_years(years)
    start = base * bounded_power(1 + growth, n) * bounded_power(1 + discount, -n)
    return growth_value(start, discount, later_years, later_growth)


def unit_value(value: Column, unit: Column) -> Column:
    scale = F.when(unit == "USD_millions", 1e6).when(unit == "thousand_shares", 1e3).when(unit == "million_shares", 1e6).when(unit == "percent", 0.01).otherwise(1.0)
    return value * scale


def base_unit(unit: Column) -> Column:
    return F.when(unit.isin("USD_millions", "USD_per_share"), "USD").when(unit.isin("thousand_shares", "million_shares"), "shares").when(unit == "percent", "ratio").otherwise(unit)
