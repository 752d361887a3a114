"""Institutional holdings: positions, actions, turnover, manager profiles and consensus scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import numbers as N

from .latest import period_index

#: numbers from here on are summed as plain doubles
LARGE = 1e15


def exact_parts(c: str) -> dict[str, Column]:
    """Sums that don't depend on the order of addition: whole units, millionths, and the plain sum for numbers that are too large."""
    v = F.col(c).cast("double")
    big = F.isnan(v) | (F.abs(v) >= LARGE)
    unit = F.when(~big, F.floor(v))
    part = F.when(~big, F.floor((v - F.floor(v)) * 1e6 + 0.5))
    return {f"{c}_units": F.try_sum(unit), f"{c}_parts": F.try_sum(part), f"{c}_plain": F.sum(v), f"{c}_big": F.bool_or(big)}


def exact_value(c: str, over=None) -> Column:
    """The sum of the parts of c, over a window if given."""
    add = (lambda x: F.try_sum(x).over(over)) if over is not None else F.col
    plain = F.sum(f"{c}_plain").over(over) if over is not None else F.col(f"{c}_plain")
    big = F.bool_or(f"{c}_big").over(over) if over is not None else F.col(f"{c}_big")
    return F.coalesce(F.when(~big, add(f"{c}_units") + add(f"{c}_parts") / 1e6), plain)


def positions(holdings: DataFrame) -> DataFrame:
    """manager, stock, period -> shares, value, weight (of the manager's period total), position_rank.

    Shares and values are rounded to millionths and added exactly, whatever the order of rows; sums
    with a number of 1e15 or more, or beyond a long, are plain double sums, which aren't rounded.
    """
    p = holdings.groupBy("manager", "stock", "period").agg(*[e.alias(k) for c in ("shares", "value") for k, e in exact_parts(c).items()])
    w = Window.partitionBy("manager", "period")
    p = p.withColumns({"shares": exact_value("shares"), "value": exact_value("value"), "total": exact_value("value", w)})
    weight = F.coalesce(N.ratio(F.col("value"), F.col("total")), F.lit(0.0))
    return p.select("manager", "stock", "period", "shares", "value", weight.alias("weight"), F.row_number().over(w.orderBy(F.desc("value"), "stock")).cast("long").alias("position_rank"))


def tracked(pos: DataFrame) -> DataFrame:
    """Adds idx (of the period), held_before (in the period before), previous_shares, streak,
    share_delta and action, all from one window over manager and stock."""
    now = pos.join(period_index(pos, "period"), "period")
    w = Window.partitionBy("manager", "stock").orderBy("idx")
    held = F.coalesce(F.lag("idx").over(w) == F.col("idx") - 1, F.lit(False))
    now = now.withColumn("held_before", held).withColumn("previous_shares", F.when(held, F.lag("shares").over(w)))
    start = F.max(F.when(~F.col("held_before"), F.col("idx"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    now = now.withColumn("streak", F.col("idx") - start + 1)
    change = N.share_change(F.col("shares"), F.col("previous_shares"))
    return now.withColumns({"share_delta": change, "action": N.action(F.col("shares"), F.col("previous_shares"))})


def actions(pos: DataFrame) -> DataFrame:
    """Adds previous_shares (of the period before, if held then), share_delta and action."""
    return tracked(pos).select(*pos.columns, "previous_shares", "share_delta", "action")


def turnover(pos: DataFrame) -> DataFrame:
    """manager, period, turnover: stocks held in just one of a period and the one before, over stocks held in either."""
    return profiles(pos).select("manager", "period", "turnover")


def profiles(pos: DataFrame) -> DataFrame:
    """manager, period: top_ten weight, names, mean_streak, turnover, kind and manager_weight."""
    rows = tracked(pos)
    top = F.sum(F.when(F.col("position_rank") <= 10, F.col("weight"))).alias("top_ten")
    p = rows.groupBy("manager", "period", "idx").agg(top, F.count("*").alias("names"), F.avg("streak").alias("mean_streak"), F.count_if("held_before").alias("both"))
    w = Window.partitionBy("manager").orderBy("idx")
    p = p.withColumn("before", F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag("names").over(w)))
    return judged(p).select("manager", "period", "top_ten", "names", "mean_streak", "turnover", "kind", "manager_weight")


def judged(p: DataFrame) -> DataFrame:
    """Adds turnover, kind and manager_weight to rows with top_ten, names, mean_streak, both (names
    held in the period before too) and before (names of that period, null if none)."""
    either = F.col("names") + F.col("before") - F.col("both")
    p = p.withColumn("turnover", (either - F.col("both")) / either)
    four = (F.coalesce("turnover", F.lit(0.0)), F.col("top_ten"), F.col("names"), F.col("mean_streak"))
    return p.withColumns({"kind": N.manager_kind(*four), "manager_weight": N.manager_weight(*four)})


def signals(pos: DataFrame) -> DataFrame:
    """All that a holder row of the consensus needs: action, streak, profile and signal.

    The profile comes from range windows over a manager's periods, so positions are made once.
    """
    w = Window.partitionBy("manager").orderBy("idx")
    now, last = w.rangeBetween(0, 0), w.rangeBetween(-1, -1)
    rows = tracked(pos).withColumns({
        "top_ten": F.sum(F.when(F.col("position_rank") <= 10, F.col("weight"))).over(now),
        "names": F.count("*").over(now),
        "mean_streak": F.avg("streak").over(now),
        "both": F.count_if("held_before").over(now),
        "before": F.nullif(F.count("*").over(last), F.lit(0)),
    })
    sig = N.position_signal(F.col("weight"), F.col("position_rank"), F.col("streak"), F.col("action"))
    return judged(rows).select("*", sig.alias("signal"), N.price_estimate(F.col("value"), F.col("shares")).alias("price"))


def dashboard(sig: DataFrame, min_holders: int = 3) -> DataFrame:
    """stock, period: consensus, signal and conviction scores of the holders (no limit; order and cut it as asked)."""
    n, w = F.count("*"), F.greatest("weight", F.lit(0.001))
    step = F.when(F.col("action") == "new", 1.0).when(F.col("action") == "add", 0.7).when(F.col("action") == "reduce", -0.5).otherwise(0.0)
    one = lambda c, top, most: F.least(F.lit(most), F.bround(F.least(c / top, F.lit(1.0)) * most))
    ten = F.count_if(F.col("position_rank") <= 10)
    out = sig.groupBy("stock", "period").agg(
        n.cast("long").alias("consensus"),
        F.sum(F.col("manager_weight") * F.col("signal")).alias("signal_score"),
        F.count_if(F.col("action") == "new").alias("n_new"),
        F.count_if(F.col("action") == "add").alias("n_add"),
        F.count_if(F.col("action") == "reduce").alias("n_reduce"),
        F.count_if(F.col("manager_weight") >= 0.75).alias("n_high_signal"),
        F.min("price").alias("price_low"),
        F.max("price").alias("price_high"),
        F.max("streak").alias("streak_max"),
        F.median("streak").alias("streak_median"),
        (F.sum(step * w) / F.sum(w)).alias("add_intensity"),
        F.least(F.lit(30.0), F.bround(F.least(F.max("weight") / 0.10, F.lit(1.0)) * 20 + F.least(ten / 2, F.lit(1.0)) * 10)).alias("position_importance"),
        one(F.median("streak"), 4, 25.0).alias("holding_persistence"),
        one(F.sum(F.col("manager_weight").cast("decimal(2,1)")).cast("double") / n, 1, 20.0).alias("manager_quality"),
        F.least(F.lit(15.0), F.bround(F.count_if(F.col("action").isin("new", "add")) / n * 15)).alias("recent_action"),
        one(n, 5, 10.0).alias("agreement"),
        (F.count_if(F.col("kind") == "unknown") / n).alias("unknown_share"),
        F.coalesce(F.bool_or(F.col("kind") == "high_turnover"), F.lit(False)).alias("any_high_turnover"),
    )
    parts = ["position_importance", "holding_persistence", "manager_quality", "recent_action", "agreement"]
    out = out.where(F.col("consensus") >= min_holders).withColumn("conviction", sum((F.col(p) for p in parts[1:]), F.col(parts[0])))
    confidence = F.when(F.col("unknown_share") >= 0.75, F.when(F.col("streak_max") < 2, "low").otherwise("medium")).when(F.col("streak_max") >= 4, "high").otherwise("medium")
    flag = lambda key, c: F.when(c, F.lit(key))
    flags = F.array_compact(F.array(flag("unknown_manager_type_heavy", F.col("unknown_share") >= 0.5), flag("high_turnover_holders", F.col("any_high_turnover")), flag("low_conviction", F.col("conviction") < 50), flag("short_holding_streak", F.col("streak_max") < 2), flag("low_score_confidence", F.col("confidence") == "low")))
    return out.withColumn("confidence", confidence).withColumn("flags", flags).withColumn("streak_median", F.floor("streak_median"))


def top(board: DataFrame, sort: str = "signal_score", limit: int = 50) -> DataFrame:
    """The board by a sort key (unknown ones mean signal_score); a limit of 0 or less means all."""
    keys = {"signal_score": "signal_score", "consensus": "consensus", "conviction": "conviction", "add_intensity": "add_intensity", "quality": "confidence"}
    out = board.orderBy(F.desc(keys.get(sort, "signal_score")), "stock", "period")
    return out.limit(limit) if limit > 0 else out


def top_holders(sig: DataFrame, n: int = 3) -> DataFrame:
    """stock, period, holders: the n heaviest holders as an array of structs."""
    w = Window.partitionBy("stock", "period").orderBy(F.desc("weight"), "manager")
    few = sig.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return few.groupBy("stock", "period").agg(F.transform(F.sort_array(F.collect_list(F.struct("__rn", "manager", "weight"))), lambda x: F.struct(x["manager"].alias("manager"), x["weight"].alias("weight"))).alias("holders"))


def timeline(pos: DataFrame, min_coverage: int = 3) -> DataFrame:
    """period, managers, is_latest_complete: the newest period of at least 80 % of the fullest one's managers."""
    p = pos.groupBy("period").agg(F.count_distinct("manager").alias("managers"))
    all_ = Window.partitionBy()  # one row per period
    enough = F.col("managers") >= F.greatest(F.lit(min_coverage), F.ceil(F.max("managers").over(all_) * 0.8))
    newest = F.max(F.when(enough, F.col("period"))).over(all_)
    return p.select("period", "managers", (F.col("period") == F.coalesce(newest, F.max("period").over(all_))).alias("is_latest_complete"))
