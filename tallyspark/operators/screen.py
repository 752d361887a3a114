"""Screens over long facts (rules compiled to one aggregate) and a safe formula language compiled to columns."""

from __future__ import annotations

import ast
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq, "==": operator.eq}
# fixed values
ALIASES = {"pe_ratio": "val.pe", "dividend_yield": "val.dividend_yield", "common_stock_shares_outstanding": "equity.shares_outstanding"}


def condition(c: dict) -> Column | None:
    """The test of one condition on a fact row; an unknown operator tests nothing."""
    compare = COMPARE.get(c["operator"])
    return None if compare is None else compare(F.col("value"), F.lit(c["value"]))


def matches(facts: DataFrame, rule: dict, stocks: DataFrame) -> DataFrame:
    """stock: distinct stocks that meet every condition by some current fact, in one pass over the facts.

    A rule that isn't of type AND, or has no conditions, keeps all stocks.
    """
    conditions = rule.get("conditions") or []
    if rule.get("type") != "AND" or not conditions:
        return stocks.select("stock").distinct()
    keyed = [(ALIASES.get(c["metric"], c["metric"]), condition(c)) for c in conditions]
    met = [F.bool_or((F.col("metric_key") == k) & (F.lit(True) if t is None else t)).alias(f"m{i}") for i, (k, t) in enumerate(keyed)]
    found = facts.where(F.col("metric_key").isin(sorted({k for k, _ in keyed}))).groupBy("stock").agg(*met)
    return found.where(reduce(operator.and_, [F.col(f"m{i}") for i in range(len(met))])).select("stock").join(stocks.select("stock"), "stock", "left_semi")


def joined(facts: DataFrame, rule: dict, stocks: DataFrame) -> DataFrame:
    """stock, one row for every combination of facts that meet the conditions (duplicates stay)."""
    out = stocks.select("stock")
    for c in rule["conditions"]:
        test = condition(c)
        part = facts.where(F.col("metric_key") == ALIASES.get(c["metric"], c["metric"]))
        out = out.join((part if test is None else part.where(test)).select("stock"), "stock")
    return out


def best_metrics(facts: DataFrame, outputs: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """stock and a column per output: value of the newest (period_end, created, fact_id) fact of its key and period types; estimates don't count."""
    actual = facts.where(F.coalesce("nature", F.lit("")) != "estimate")
    order = F.struct("period_end", "created", "fact_id")
    pick = lambda key, kinds: F.max_by("value", F.when((F.col("metric_key") == key) & F.col("period_type").isin(kinds), order))
    return actual.where(F.col("metric_key").isin(sorted({k for k, _ in outputs.values()}))).groupBy("stock").agg(*[pick(k, kinds).alias(name) for name, (k, kinds) in outputs.items()])


BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Pow: lambda a, b: F.pow(a, b), ast.Div: lambda a, b: F.try_divide(a, b)}


def dependencies(expression: str) -> list[str]:
    """Names a formula reads, sorted; function calls are an error."""
    tree = ast.parse(expression, mode="eval")
    if any(isinstance(n, ast.Call) for n in ast.walk(tree)):
        raise ValueError("function calls are not allowed")
    return sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)})


def formula(expression: str, columns: dict[str, Column]) -> Column:
    """A formula of + - * / ** and unary - as a column; division by zero is null."""

    def build(n: ast.AST) -> Column:
        if isinstance(n, ast.BinOp) and type(n.op) in BINARY:
            return BINARY[type(n.op)](build(n.left), build(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -build(n.operand)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            if n.id not in columns:
                raise KeyError(f"no variable {n.id}")
            return columns[n.id]
        raise ValueError(f"not allowed: {type(n).__name__}")

    dependencies(expression)
    return build(ast.parse(expression, mode="eval").body)


def run_formula(facts: DataFrame, name: str, expression: str, keys: dict[str, str]) -> DataFrame:
    """stock, metric_key, value: the formula over each stock's newest facts; no row where an input is missing."""
    names = dependencies(expression)
    pick = [F.max_by("value", F.when(F.col("metric_key") == keys.get(n, n), F.struct("period_end", "fact_id"))).alias(n) for n in names]
    table = facts.groupBy("stock").agg(*pick).dropna(subset=names)
    return table.select("stock", F.lit(name.lower().replace(" ", "_")).alias("metric_key"), formula(expression, {n: F.col(n) for n in names}).alias("value"))
