"""Read models over facts, documents, prices and filings: a row a stock, document or manager, for all of them at once.

facts: fact, user, stock, metric_key, value, period_type, period_end, created, source_type, document,
is_current, nature; prices: stock, day, close, created.  Of several facts for one place the newest period
counts (a missing one last), then the newest creation, then the greatest fact id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import dates as D

from .latest import first_per_key

# fixed values: names and keys of the page's metrics
QUALITY = {"piotroski_total": "score.piotroski.total", "return_on_total_capital": "bs.return_on_total_capital", "return_on_equity": "bs.return_on_equity", "net_profit_margin": "is.net_profit_margin", "debt_to_capital": "leverage.long_term_debt_to_capital", "owners_earnings": "owners_earnings_per_share_normalized"}
FAIR_VALUE, TARGET = "val.fair_value", "target.price_18m.mid"
DCF = {"net_profit_per_share": "per_share.eps", "depreciation": "is.depreciation", "shares_outstanding": "equity.shares_outstanding", "capital_spending_per_share": "per_share.capital_spending"}
GROWTH = {"sales": "rates.sales.cagr_est", "revenues": "rates.revenues.cagr_est", "cash_flow": "rates.cash_flow.cagr_est", "earnings": "rates.earnings.cagr_est"}
SERIES = "owners_earnings_per_share"

_NEWEST = ("period_end", "created", "fact")


def _dated(c: str | Column) -> Column:
    return F.coalesce(c, F.lit("0001-01-01").cast("date"))


def _order(*cols: str) -> Column:
    return F.struct(*[_dated(F.col(c)) if c == "period_end" else F.col(c) for c in cols])


def _pick(key: str, what: Column, where: Column | None = None, order: Column | None = None) -> Column:
    """``what`` of the newest fact of a key, over a group."""
    ok = F.col("metric_key") == key
    return F.max_by(what, F.when(ok if where is None else ok & where, _order(*_NEWEST) if order is None else order))


def active_reports(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """stock, document, report_date of the report that counts: the newest date (a missing one last), then the greatest document."""
    rows = facts.where("source_type = 'parsed' and document is not null and stock is not null").select("stock", "document").distinct()
    top = F.max(F.struct(_dated("report_date").alias("d"), "document", "report_date"))
    return rows.join(documents.select("document", "report_date"), "document").groupBy("stock").agg(top.alias("x")).select("stock", "x.document", "x.report_date")


def newest_prices(prices: DataFrame, until: Column | None = None) -> DataFrame:
    """stock, price, price_day of the newest day (up to ``until``), then the newest creation."""
    rows = prices if until is None else prices.where(F.col("day") <= until)
    return rows.groupBy("stock").agg(F.max_by(F.struct("close", "day"), F.struct("day", "created")).alias("x")).select("stock", F.col("x.close").alias("price"), F.col("x.day").alias("price_day"))


def quality_overlay(stocks: DataFrame, facts: DataFrame, prices: DataFrame, until: Column | None = None) -> DataFrame:
    """A row a stock: the quality metrics, owner-earnings yield, coverage, reasons for what is missing and provenance.

    stocks may repeat; each comes once.
    """
    info = F.struct("value", "document", "source_type", "period_type", "period_end")
    current = facts.where(F.col("is_current") & F.col("value").isNotNull() & F.col("metric_key").isin(list(QUALITY.values())))
    wide = current.groupBy("stock").agg(*[_pick(key, info).alias(f"__{name}") for name, key in QUALITY.items()])
    rows = stocks.select("stock").distinct().join(wide, "stock", "left").join(newest_prices(prices, until), "stock", "left")
    value = lambda name: F.col(f"__{name}.value")
    earned = value("owners_earnings")
    rows = rows.withColumns({n: value(n) for n in QUALITY if n != "owners_earnings"}).withColumn("owner_earnings_yield", F.when(F.col("price") != 0, earned / F.col("price")))
    shown = [n for n in QUALITY if n != "owners_earnings"] + ["owner_earnings_yield"]
    none = F.lit(True)
    for n in QUALITY:
        none = none & F.col(f"__{n}").isNull()
    reasons = F.array_compact(F.array(
        F.when(none, "missing report facts"),
        F.when(F.col("price").isNull(), "missing price"),
        F.when(earned.isNull(), "missing normalized owner earnings").when(F.col("owner_earnings_yield").isNull(), "owner earnings yield unavailable without price"),
    ))
    found = F.array_compact(F.array(*[F.when(F.col(f"__{n}").isNotNull(), F.struct(F.lit(n).alias("label"), F.lit(k).alias("metric_key"), F.col(f"__{n}.document"), F.col(f"__{n}.source_type"), F.col(f"__{n}.period_type"), F.col(f"__{n}.period_end"))) for n, k in QUALITY.items()]))
    documents = F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x["document"]), lambda d: d.isNotNull())))
    reported = F.lit(False)
    for n in shown[:-1]:
        reported = reported | F.col(f"__{n}").isNotNull()
    available = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in shown), F.lit(0))
    return rows.select("stock", *shown, F.col("price").alias("latest_price"), F.col("price_day").alias("price_date"), reported.alias("has_report"), available.cast("long").alias("available_metrics"), reasons.alias("unavailable_reasons"), F.get(documents, F.lit(0)).alias("primary_document"), documents.alias("source_documents"), found.alias("provenance"))


def valuation_reference(ranges: DataFrame, facts: DataFrame, prices: DataFrame, until: Column | None = None) -> DataFrame:
    """A row a stock of ranges (stock, holder_low, holder_high): a manual fair value, else the analyst's target, against the price.

    Of several facts the newest creation counts, whatever its period.
    """
    newest = F.struct("created", "fact")
    ok = facts.where(F.col("is_current") & F.col("value").isNotNull())
    wide = ok.groupBy("stock").agg(_pick(FAIR_VALUE, F.col("value"), F.col("source_type") == "manual", newest).alias("__manual"), _pick(TARGET, F.col("value"), None, newest).alias("__target"))
    rows = ranges.join(wide, "stock", "left").join(newest_prices(prices, until), "stock", "left")
    manual, target, price = F.col("__manual"), F.col("__target"), F.col("price")
    by = lambda a, b, c: F.when(manual.isNotNull(), a).when(target.isNotNull(), b).otherwise(c)
    reference = F.coalesce(manual, target)
    reasons = F.array_compact(F.array(F.when(price.isNull(), "missing price"), F.when(reference.isNull(), "missing valuation reference"), F.when(F.col("holder_low").isNull() | F.col("holder_high").isNull(), "missing holder price estimate")))
    return rows.select(
        "stock", F.col("price").alias("current_price"), F.col("price_day").alias("current_price_date"), reference.alias("valuation_reference"),
        by("manual_intrinsic_value", "analyst_target_reference", "missing").alias("reference_type"), by("user_supplied", "medium", "unavailable").alias("reference_confidence"),
        F.when(reference != 0, F.round((reference - price) / reference, 6)).alias("discount_to_reference"),
        F.coalesce(price < F.col("holder_low"), F.lit(False)).alias("below_holder_estimate"), F.coalesce(price < reference, F.lit(False)).alias("below_reference"), reasons.alias("unavailable_reasons"),
    )


def score_card(facts: DataFrame, checks: list[str], total: str, n_years: int = 5) -> DataFrame:
    """stock, metric_key, years, scores, natures, status, level: a row a check and one for the total of each stock with a score.

    Years are the last n_years in which any of the keys has a current calculated FY fact, oldest first.  status of a
    check: ``warning`` without scores, ``success`` or ``danger`` by the last year's 1 or 0, else ``warning``; level is
    ``all`` where every year's score is 1.  The total's status is ``secondary``, its level ``strong`` from
    7 on (newest score that is there), ``watch`` below and ``none`` without one.
    """
    keys = [*checks, total]
    rows = facts.where((F.col("source_type") == "calculated") & F.col("is_current") & (F.col("period_type") == "FY") & F.col("metric_key").isin(keys) & F.col("period_end").isNotNull())
    each = rows.groupBy("stock", F.year("period_end").alias("year"), "metric_key").agg(F.max_by(F.struct("value", "nature"), _order(*_NEWEST)).alias("x"))
    # a stock has as many entries as it has keys and years
    card = each.groupBy("stock").agg(F.sort_array(F.collect_set("year"), asc=False).alias("__y"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "metric_key", F.col("year").cast("string")).alias("at"), "x"))).alias("__m"))
    card = card.withColumn("years", F.array_sort(F.slice("__y", 1, n_years))).withColumn("metric_key", F.explode(F.array(*map(F.lit, keys))))
    at = lambda y: F.try_element_at("__m", F.concat_ws("/", F.col("metric_key"), y.cast("string")))
    card = card.withColumn("scores", F.transform("years", lambda y: at(y)["value"])).withColumn("natures", F.transform("years", lambda y: at(y)["nature"]))
    there = F.filter("scores", lambda s: s.isNotNull())
    last, is_total = F.element_at("scores", -1), F.col("metric_key") == total
    status = F.when(is_total, "secondary").when(last == 1, "success").when(last == 0, "danger").otherwise("warning")
    newest = F.try_element_at(there, F.lit(-1))
    level = F.when(is_total, F.when(newest >= 7, "strong").when(newest.isNotNull(), "watch").otherwise("none")).when(F.forall("scores", lambda s: F.coalesce(s == 1, F.lit(False))), "all")
    return card.select("stock", "metric_key", "years", "scores", "natures", status.alias("status"), level.alias("level"))


def compared_years(facts: DataFrame, n_actual: int = 5, n_estimate: int = 2) -> DataFrame:
    """Facts of the last actual and the first estimated years of each stock; one without a period goes."""
    rows = facts.where("period_end is not null").withColumn("__e", F.coalesce(F.col("nature") == "estimate", F.lit(False)))
    actual = first_per_key(rows.where("not __e"), ["stock"], [F.year("period_end").desc(), F.desc("fact")], n_actual)
    estimate = first_per_key(rows.where("__e"), ["stock"], [F.year("period_end"), F.col("fact")], n_estimate)
    return actual.unionByName(estimate).drop("__e")


def stock_pages(stocks: DataFrame, facts: DataFrame, prices: DataFrame, documents: DataFrame, target: Column) -> DataFrame:
    """A row a stock: active report, price of the target day or else the newest, the series of owner's earnings, valuation inputs and growth options.

    stocks: stock, ticker, exchange, listing_exchange, company.  One aggregate reads a stock's current facts:

    - series: the six newest FY owner's earnings (year, value; null is 0) with their inputs (a missing one is
      0 with source ``missing``; depreciation a share is ``computed`` where shares are positive);
    - dcf_year: the year at the median place of the newest five values (ties by period);
    - growth: sales, or revenues without it, cash flow and earnings, in per cent;
    - based_on: the normalized value, else the first of the series; growth_default: the lowest option, the first of equals.
    """
    fy = F.col("period_type") == "FY"
    entry = F.struct(F.col("period_end"), F.col("created"), F.col("fact"), F.col("metric_key"), F.col("value"))
    current = facts.where(F.col("is_current") & F.col("metric_key").isin("mkt.price", "val.pe", f"{SERIES}_normalized", SERIES, *DCF.values(), *GROWTH.values()))
    wide = current.groupBy("stock").agg(
        _pick("mkt.price", F.col("value")).alias("price"), _pick("val.pe", F.col("value")).alias("pe"), _pick(f"{SERIES}_normalized", F.col("value")).alias("oeps_normalized"),
        # a stock's years, a few dozen entries
        F.slice(F.sort_array(F.collect_list(F.when((F.col("metric_key") == SERIES) & fy & F.col("period_end").isNotNull(), entry)), asc=False), 1, 6).alias("__s"),
        F.collect_list(F.when(F.col("metric_key").isin(list(DCF.values())) & fy & F.col("period_end").isNotNull(), entry)).alias("__i"),
        *[_pick(k, F.col("value"), F.col("value").isNotNull()).alias(f"__g_{n}") for n, k in GROWTH.items()],
    )
    of = lambda s, k: F.array_max(F.filter("__i", lambda i: (i["period_end"] == s["period_end"]) & (i["metric_key"] == DCF[k])))["value"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def inputs(s: Column) -> Column:
        shares, dep = of(s, "shares_outstanding"), of(s, "depreciation")
        positive = F.coalesce(shares > 0, F.lit(False))
        source = lambda c, word="fact": F.when(c, word).otherwise("missing")
        eps, capex = of(s, "net_profit_per_share"), of(s, "capital_spending_per_share")
        return F.struct(
            F.year(s["period_end"]).alias("year"), zero(s["value"]).alias("value"), s["period_end"].alias("period_end"), zero(eps).alias("eps"), source(eps.isNotNull()).alias("eps_source"), zero(capex).alias("capex"), source(capex.isNotNull()).alias("capex_source"),
            F.when(positive, zero(dep) / shares).otherwise(0.0).alias("depreciation"), source(positive & dep.isNotNull(), "computed").alias("depreciation_source"),
        )

    wide = wide.withColumn("series", F.transform("__s", inputs))
    five = F.array_sort(F.transform(F.slice("series", 1, 5), lambda x: F.struct(x["value"], x["period_end"], x["year"])))
    wide = wide.withColumn("dcf_year", F.get(five, F.floor(F.size(five) / 2).cast("int"))["year"])
    option = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("key"), (c * 100).alias("value")))
    g = lambda n: F.col(f"__g_{n}")
    wide = wide.withColumn("growth", F.array_compact(F.array(F.coalesce(option("sales", g("sales")), option("revenues", g("revenues"))), option("cash_flow", g("cash_flow")), option("earnings", g("earnings")))))
    lowest = F.array_min(F.transform("growth", lambda x, i: F.struct(x["value"], i, x["key"])))
    wide = wide.withColumn("growth_default", lowest["key"])
    exact = F.max_by(F.struct("close", "day"), F.when(F.col("day") == target, F.col("created")))
    last = prices.groupBy("stock").agg(F.coalesce(exact, F.max_by(F.struct("close", "day"), F.struct("day", "created"))).alias("__p"))
    rows = stocks.join(wide, "stock", "left").join(last, "stock", "left").join(active_reports(facts, documents).select("stock", F.col("document").alias("active_document"), F.col("report_date").alias("active_date")), "stock", "left")
    based = F.coalesce("oeps_normalized", F.get("series", F.lit(0))["value"])
    return rows.select(
        "stock", "ticker", F.coalesce("listing_exchange", "exchange").alias("exchange"), "company", "active_document", "active_date", "price", "pe", "oeps_normalized",
        F.col("__p.close").alias("latest_price"), F.col("__p.day").alias("latest_price_date"), "series", "dcf_year", "growth", "growth_default", F.round(based, 3).alias("based_on"),
    )


def stock_for_ticker(stocks: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """ticker (lower case), stock: of stocks whose tickers differ in case only, the one with a report, then the newest, most current facts, active, least id."""
    counts = facts.where("is_current").groupBy("stock").agg(F.count("*").alias("n"))
    rows = stocks.join(active_reports(facts, documents).select("stock", "report_date", F.lit(1).alias("has")), "stock", "left").join(counts, "stock", "left")
    score = F.struct(F.coalesce("has", F.lit(0)), _dated("report_date"), F.coalesce("n", F.lit(0)), F.col("is_active").cast("int"), -F.col("stock"))
    return rows.groupBy(F.lower(F.trim("ticker")).alias("ticker")).agg(F.max_by("stock", score).alias("stock"))


def document_list(documents: DataFrame, pages: DataFrame, extractions: DataFrame, facts: DataFrame, stocks: DataFrame) -> DataFrame:
    """A row a document: counts of pages and parsed pages, template, companies by ticker, the tickers it is the active report of, and sort_ticker (``~`` without companies).

    documents: document, stock, source, report_date; pages: document; extractions: document, page, version;
    stocks: stock, ticker.  Active reports are chosen among these documents.
    """
    n_pages = pages.groupBy("document").agg(F.count("*").alias("page_count"))
    parsed = extractions.groupBy("document").agg(F.count_distinct("page").alias("parsed_page_count"), F.max("version").alias("version"))
    named = facts.where("source_type = 'parsed' and document is not null").select("document", "stock").unionByName(documents.where("stock is not null").select("document", "stock")).distinct()
    companies = named.join(stocks.select("stock", "ticker"), "stock").groupBy("document").agg(F.sort_array(F.collect_list("ticker")).alias("companies"))
    active = active_reports(facts, documents).join(stocks.select("stock", "ticker"), "stock").groupBy("document").agg(F.sort_array(F.collect_list("ticker")).alias("active_for"))
    rows = documents.join(n_pages, "document", "left").join(parsed, "document", "left").join(companies, "document", "left").join(active, "document", "left")
    none = F.array().cast("array<string>")
    label = F.when(F.col("version") == "v1", "Report (v1)").otherwise(F.coalesce(F.nullif("source", F.lit("")), F.lit("Unknown")))
    out = rows.select("document", "report_date", label.alias("template"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("page_count", "parsed_page_count")], F.coalesce("companies", none).alias("companies"), F.coalesce("active_for", none).alias("active_for"))
    return out.withColumn("is_active_report", F.size("active_for") > 0).withColumn("sort_ticker", F.coalesce(F.nullif(F.upper(F.get("companies", F.lit(0))), F.lit("")), F.lit("~")))


# institutions


def in_quarter(day: Column, label: Column) -> Column:
    """The day lies in the quarter of a label such as 2024-Q4; null for other labels."""
    ok = label.rlike(r"^\d{4}-[Qq][1-4]$")
    return F.when(ok, (day >= D.quarter_start(F.upper(label))) & (day <= D.quarter_end(F.upper(label))))


def confirmed(managers: DataFrame) -> DataFrame:
    return managers.where("match_status = 'confirmed' and cik is not null")


def filings_of(managers: DataFrame, filings: DataFrame, quarter: Column | None = None) -> DataFrame:
    """All filing versions of confirmed managers (of one quarter), with the manager's cik and name."""
    rows = filings if quarter is None else filings.where(in_quarter(F.col("period"), quarter))
    return rows.join(confirmed(managers).select("manager", "cik", "name"), "manager")


def holdings_of(managers: DataFrame, filings: DataFrame, holdings: DataFrame, codes: DataFrame, quarter: Column | None = None, all_versions: bool = False) -> DataFrame:
    """Holdings of confirmed managers' filings (the latest of a period unless all_versions), with the ticker of their active code.

    codes: code, ticker, is_active; of several active tickers of a code the least counts.
    """
    own = filings_of(managers, filings if all_versions else filings.where("is_latest"), quarter)
    tickers = codes.where("is_active and ticker is not null").groupBy("code").agg(F.min("ticker").alias("ticker"))
    return holdings.join(own.select("filing", "manager", "cik", "period"), "filing").join(tickers, "code", "left")


def holders_of(managers: DataFrame, filings: DataFrame, holdings: DataFrame, codes: DataFrame) -> DataFrame:
    """ticker, manager: confirmed managers with the ticker's code in any latest filing; of several active codes of a ticker the least counts."""
    one = codes.where("is_active and ticker is not null").groupBy(F.upper("ticker").alias("ticker")).agg(F.min("code").alias("code"))
    latest = filings.where("is_latest").join(confirmed(managers).select("manager"), "manager", "left_semi").select("filing", "manager")
    return holdings.select("filing", "code").join(latest, "filing").select("code", "manager").distinct().join(one, "code").select("ticker", "manager")


def price_targets(managers: DataFrame, filings: DataFrame, holdings: DataFrame, prices: DataFrame, superinvestors: bool = True) -> DataFrame:
    """stock, target (the business day on or before the period's end), period (the newest for it), status: prices that latest filings ask for.

    Only linked holdings without put or call count; status is ``up_to_date`` where a price of that day is there, else ``missing``.
    """
    who = confirmed(managers)
    who = who.where("is_superinvestor") if superinvestors else who
    latest = filings.where("is_latest").join(who.select("manager"), "manager", "left_semi").select("filing", "period")
    rows = holdings.where("stock is not null and put_call is null").select("filing", "stock").join(latest, "filing").select("stock", "period", D.business_day_on_or_before(F.col("period")).alias("target"))
    asked = rows.groupBy("stock", "target").agg(F.max("period").alias("period"))
    have = prices.select("stock", F.col("day").alias("target"), F.lit("up_to_date").alias("status")).distinct()
    return asked.join(have, ["stock", "target"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


_CHART = "struct<chart:struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>>>"


def picked_bars(charts: DataFrame, symbol: str, payload: str, target: Column, zone: str = "America/New_York") -> DataFrame:
    """symbol, open, high, low, close, volume of a chart's first bar with a close on the target day, by the exchange's clock.

    Where a series ends before the bar, open, high and low are the close and the volume is 0; a null
    inside one leaves the symbol without a bar, as does a payload that can't be read.
    """
    r0 = F.get(F.from_json(payload, _CHART)["chart"]["result"], F.lit(0))
    q0 = F.get(r0["indicators"]["quote"], F.lit(0))
    rows = charts.select(F.col(symbol).alias("symbol"), target.alias("__day"), q0.alias("q"), F.posexplode(r0["timestamp"]).alias("i", "ts"))
    rows = rows.where(F.to_date(F.from_utc_timestamp(F.timestamp_seconds("ts"), zone)) == F.col("__day"))
    close = F.get("q.close", F.col("i"))
    rows = rows.withColumn("close", close).where("close is not null")
    part = lambda name, other: F.when(F.coalesce(F.size(f"q.{name}"), F.lit(0)) > F.col("i"), F.get(f"q.{name}", F.col("i"))).otherwise(other)
    bar = F.struct(part("open", F.col("close")).alias("open"), part("high", F.col("close")).alias("high"), part("low", F.col("close")).alias("low"), "close", part("volume", F.lit(0.0)).alias("volume"))
    out = rows.groupBy("symbol").agg(F.min_by(bar, "i").alias("b")).select("symbol", "b.*")
    return out.dropna(subset=["open", "high", "low", "volume"])


def payload(rows: DataFrame, by: str, order: list[Column], fields: list[str], limit: int = 50) -> DataFrame:
    """by, payload: a nested JSON text a group, with its key, the number of its rows and the first ``limit`` of them as items.

    The limit is the page's; nulls are written; rows without a key are left out.  ``order`` must be total for texts to be the same at every run.
    """
    top = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__rn") <= limit)
    items = top.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__rn", F.struct(*fields).alias("item")))), lambda x: x["item"]).alias("items"))
    whole = rows.groupBy(by).agg(F.count("*").alias("total")).join(items, by)
    return whole.select(by, F.to_json(F.struct(by, "total", "items"), {"ignoreNullFields": "false"}).alias("payload"))
