"""Read-model queries over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyspark.functions import dates as D
from tallyspark.operators import documents as DOC
from tallyspark.operators import pages as P

from . import analog as A
from .registry import query

CHECKS = ["score.c1", "score.c2", "score.c3"]
#: key, value of a supplier's year (q: quantity, n: line numbers, s: supplier), source, kind of period, where; the same text for Spark and DuckDB
_KEYS = [
    ("score.piotroski.total", "cast(n % 10 as double)", "calculated", "FY", "q % 9 <> 0"),
    *[(k, f"case when (q + {i}) % 5 = 0 then null else cast((n + {i}) % 4 > 0 as int) * 1.0e0 end", "calculated", "FY", f"(q + {i}) % 7 <> 0") for i, k in enumerate(CHECKS)],
    ("bs.return_on_total_capital", "cast(q as double) / 1000", "parsed", "FY", "q % 2 = 0"),
    ("bs.return_on_equity", "cast(n as double) / 1000", "parsed", "FY", "s % 3 <> 0"),
    ("is.net_profit_margin", "case when n % 3 = 0 then null else cast(n as double) / 50 end", "parsed", "FY", "s % 4 <> 1"),
    ("owners_earnings_per_share_normalized", "cast(q as double) / 10", "calculated", "AS_OF", "s % 5 <> 2"),
    ("owners_earnings_per_share", "case when q % 6 = 0 then null else cast(q as double) / 7 end", "calculated", "FY", "s % 7 <> 3"),
    ("val.fair_value", "cast(q as double) / 90", "manual", "AS_OF", "s % 4 = 0"),
    ("val.fair_value", "cast(q as double) / 80", "parsed", "AS_OF", "s % 4 = 1"),
    ("target.price_18m.mid", "cast(n as double) / 6", "parsed", "AS_OF", "s % 6 <> 5"),
    ("per_share.eps", "cast(q as double) / 30", "parsed", "FY", "q % 3 <> 0"),
    ("is.depreciation", "cast(n as double)", "parsed", "FY", "q % 4 <> 0"),
    ("equity.shares_outstanding", "cast(n % 7 as double)", "parsed", "FY", "q % 5 <> 0"),
    ("per_share.capital_spending", "cast(n as double) / 40", "parsed", "FY", "n % 3 <> 0"),
    ("rates.sales.cagr_est", "cast(n % 11 as double) / 100", "parsed", "AS_OF", "s % 3 = 0"),
    ("rates.revenues.cagr_est", "cast(n % 13 as double) / 100", "parsed", "AS_OF", "s % 2 = 0"),
    ("rates.cash_flow.cagr_est", "cast(q % 5 as double) / 100", "parsed", "AS_OF", "s % 5 <> 0"),
    ("rates.earnings.cagr_est", "cast(q % 5 as double) / 100", "parsed", "AS_OF", "s % 7 <> 0"),
    ("mkt.price", "cast(q as double) / 20", "parsed", "AS_OF", "s % 9 <> 0"),
    ("val.pe", "cast(n as double) / 9", "parsed", "AS_OF", "s % 8 <> 0"),
]
_ID = "(s * 100 + (y - 1990)) * 100"
_DOC = "case when (s + y) % 6 = 0 then null else s * 3 + (y * 7 + s) % 5 end"
_SQL_FACTS = """y as (select l_suppkey as s, year(l_shipdate) as y, sum(l_quantity)::bigint as q, sum(l_linenumber)::bigint as n from lineitem group by all),
facts as (""" + "\nunion all ".join(f"select {_ID} + {i} as fact, s % 3 as \"user\", s as stock, '{k}' as metric_key, {v} as value, '{t}' as period_type, make_date(y, 12, 31) as period_end, make_date(y + 1 - cast(s % 2 as int), 3, 1) as created, '{src}' as source_type, {_DOC} as document, ({_ID} + {i}) % 11 <> 0 as is_current, case when y >= 2000 then 'estimate' else 'actual' end as nature from y where {w}" for i, (k, v, src, t, w) in enumerate(_KEYS)) + """),
prices as (select user_id as stock, ts::date as day, value as close, event_id as created from events),
docs as (select distinct d as document, case when d % 13 = 0 then null else make_date(1996 + cast(d % 7 as int), 1 + cast(d % 12 as int), 1) end as report_date, case when d % 4 = 0 then d // 3 end as stock, case d % 3 when 0 then '' when 1 then 'mail' end as source from (select s_suppkey * 3 + i as d from supplier cross join range(5) r(i))),
active as (select stock, arg_max(document, (coalesce(report_date, date '0001-01-01'), document)) as document, arg_max(coalesce(report_date, date '9999-01-01'), (coalesce(report_date, date '0001-01-01'), document)) as d9 from (select distinct f.stock, document, report_date from facts f join docs using (document) where source_type = 'parsed') group by stock),
actives as (select stock, document, nullif(d9, date '9999-01-01') as report_date from active)"""


def _facts(spark, sf):
    y = A.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").cast("long").alias("q"), F.sum("l_linenumber").alias("n"))
    rows = F.array(*[F.when(F.expr(w), F.struct(F.expr(f"{_ID} + {i}").alias("fact"), F.lit(k).alias("metric_key"), F.expr(v).cast("double").alias("value"), F.lit(t).alias("period_type"), F.lit(src).alias("source_type"))) for i, (k, v, src, t, w) in enumerate(_KEYS)])
    out = y.select("s", "y", F.inline(F.array_compact(rows)))
    return out.select(
        "fact", (F.col("s") % 3).alias("user"), F.col("s").alias("stock"), "metric_key", "value", "period_type", F.expr("make_date(y, 12, 31)").alias("period_end"), F.expr("make_date(y + 1 - cast(s % 2 as int), 3, 1)").alias("created"), "source_type",
        F.expr(_DOC).alias("document"), (F.col("fact") % 11 != 0).alias("is_current"), F.when(F.col("y") >= 2000, "estimate").otherwise("actual").alias("nature"),
    )


def _docs(spark, sf):
    d = F.col("document")
    rows = A.table(spark, sf, "supplier").select(F.explode(F.sequence(F.col("s_suppkey") * 3, F.col("s_suppkey") * 3 + 4)).alias("document")).distinct()
    day = F.when(d % 13 != 0, F.make_date((1996 + d % 7).cast("int"), (1 + d % 12).cast("int"), F.lit(1)))
    return rows.select("document", day.alias("report_date"), F.when(d % 4 == 0, F.floor(d / 3)).alias("stock"), F.when(d % 3 == 0, "").when(d % 3 == 1, "mail").alias("source"))


def _prices(spark, sf):
    return A.prices(spark, sf).select("stock", "day", "close", F.col("event_id").alias("created"))


def _stocks(spark, sf):
    s = A.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("stock"), F.concat(F.lit("T"), (F.col("s_suppkey") % 40).cast("string")).alias("ticker"), F.lit("US").alias("exchange"), F.when(F.col("s_suppkey") % 3 == 0, "NYSE").alias("listing_exchange"), F.col("s_name").alias("company"), (F.col("s_suppkey") % 5 != 0).alias("is_active"))


_SQL_STOCKS = "stocks as (select s_suppkey as stock, 'T' || s_suppkey % 40 as ticker, 'US' as exchange, case when s_suppkey % 3 = 0 then 'NYSE' end as listing_exchange, s_name as company, s_suppkey % 5 <> 0 as is_active from supplier)"


@query(f"with {_SQL_FACTS} select stock, document, report_date from actives")
def w07_active_reports(spark, sf):
    return P.active_reports(_facts(spark, sf), _docs(spark, sf))


_PRICE = "price as (select stock, arg_max(close, (day, created)) as price, max(day) as price_day from prices where day <= date '2024-01-20' group by stock)"


@query(f"""with {_SQL_FACTS}, {_PRICE},
p as (select *, row_number() over (partition by stock, metric_key order by period_end desc, created desc, fact desc) as rn from facts where is_current and value is not null),
w as (select s_suppkey as stock, {", ".join(f"max(value) filter (metric_key = '{k}') as {n}" for n, k in P.QUALITY.items())}, count(p.fact) as n, list_sort(list_distinct(list(document) filter (document is not null))) as ds from supplier left join p on p.stock = s_suppkey and rn = 1 and metric_key in ({", ".join(f"'{k}'" for k in P.QUALITY.values())}) group by all),
v as (select w.*, price, price_day, owners_earnings / nullif(price, 0) as owner_earnings_yield from w left join price using (stock))
select stock, piotroski_total, return_on_total_capital, return_on_equity, net_profit_margin, debt_to_capital, owner_earnings_yield, price as latest_price, price_day as price_date,
  coalesce(piotroski_total, return_on_total_capital, return_on_equity, net_profit_margin, debt_to_capital) is not null as has_report,
  (piotroski_total is not null)::bigint + (return_on_total_capital is not null)::bigint + (return_on_equity is not null)::bigint + (net_profit_margin is not null)::bigint + (debt_to_capital is not null)::bigint + (owner_earnings_yield is not null)::bigint as available_metrics,
  concat_ws(';', case when n = 0 then 'missing report facts' end, case when price is null then 'missing price' end, case when owners_earnings is null then 'missing normalized owner earnings' when owner_earnings_yield is null then 'owner earnings yield unavailable without price' end) as unavailable_reasons,
  ds[1] as primary_document, coalesce(array_to_string(ds, ','), '') as source_documents from v""")
def q02_quality_overlay(spark, sf):
    twice = _stocks(spark, sf).select("stock")
    out = P.quality_overlay(twice.unionByName(twice), _facts(spark, sf), _prices(spark, sf), F.lit(datetime.date(2024, 1, 20)))
    return out.drop("provenance").withColumns({"unavailable_reasons": F.array_join("unavailable_reasons", ";"), "source_documents": F.array_join(F.transform("source_documents", lambda d: d.cast("string")), ",")})


@query(f"""with {_SQL_FACTS}, {_PRICE}, w as (select stock, arg_max(value, (created, fact)) filter (metric_key = 'val.fair_value' and source_type = 'manual') as manual, arg_max(value, (created, fact)) filter (metric_key = 'target.price_18m.mid') as target from facts where is_current and value is not null group by stock),
v as (select s_suppkey as stock, case when s_suppkey % 4 <> 0 then s_suppkey::double end as holder_low, case when s_suppkey % 5 <> 0 then s_suppkey::double * 2 end as holder_high, manual, target, price, price_day, coalesce(manual, target) as r from supplier left join w on w.stock = s_suppkey left join price on price.stock = s_suppkey)
select stock, price as current_price, price_day as current_price_date, r as valuation_reference, case when manual is not null then 'manual_intrinsic_value' when target is not null then 'analyst_target_reference' else 'missing' end as reference_type,
  case when manual is not null then 'user_supplied' when target is not null then 'medium' else 'unavailable' end as reference_confidence, round((r - price) / nullif(r, 0), 6) as discount_to_reference, coalesce(price < holder_low, false) as below_holder_estimate, coalesce(price < r, false) as below_reference,
  concat_ws(';', case when price is null then 'missing price' end, case when r is null then 'missing valuation reference' end, case when holder_low is null or holder_high is null then 'missing holder price estimate' end) as unavailable_reasons from v""")
def q03_valuation_reference(spark, sf):
    s = F.col("stock")
    ranges = _stocks(spark, sf).select("stock", F.when(s % 4 != 0, s.cast("double")).alias("holder_low"), F.when(s % 5 != 0, s * 2.0).alias("holder_high"))
    out = P.valuation_reference(ranges, _facts(spark, sf), _prices(spark, sf), F.lit(datetime.date(2024, 1, 20)))
    return out.withColumn("unavailable_reasons", F.array_join("unavailable_reasons", ";"))


_CARD_KEYS = ", ".join(f"'{k}'" for k in [*CHECKS, "score.piotroski.total"])


@query(f"""with {_SQL_FACTS}, c as (select stock, year(period_end) as y, metric_key, value, nature, row_number() over (partition by stock, period_end, metric_key order by created desc, fact desc) as rn from facts where source_type = 'calculated' and is_current and period_type = 'FY' and metric_key in ({_CARD_KEYS})),
ys as (select stock, y, row_number() over (partition by stock order by y desc) as back from (select distinct stock, y from c)),
k as (select stock, y, back, u.metric_key from ys cross join (select unnest([{_CARD_KEYS}]) as metric_key) u where back <= 5),
v as (select k.*, value, nature from k left join c on c.stock = k.stock and c.y = k.y and c.metric_key = k.metric_key and rn = 1),
a as (select stock, metric_key, string_agg(y::varchar, ',' order by y) as years, string_agg(coalesce(value::int::varchar, '-'), ',' order by y) as scores, string_agg(coalesce(nature, '-'), ',' order by y) as natures, max(value) filter (back = 1) as last, arg_max(value, y) filter (value is not null) as newest, bool_and(coalesce(value = 1, false)) as every from v group by all)
select stock, metric_key, years, scores, natures, case when metric_key = 'score.piotroski.total' then 'secondary' when last = 1 then 'success' when last = 0 then 'danger' else 'warning' end as status,
  case when metric_key = 'score.piotroski.total' then (case when newest >= 7 then 'strong' when newest is not null then 'watch' else 'none' end) when every then 'all' end as level from a""")
def q08_score_card(spark, sf):
    card = P.score_card(_facts(spark, sf), CHECKS, "score.piotroski.total")
    text = lambda c, f=lambda x: x.cast("string"): F.array_join(F.transform(c, f), ",", "-").alias(c)
    return card.select("stock", "metric_key", text("years"), text("scores", lambda x: x.cast("int").cast("string")), text("natures"), "status", "level")


@query(f"""with {_SQL_FACTS}, f as (select stock, fact, year(period_end) as year, nature, row_number() over (partition by stock, nature = 'estimate' order by case when nature = 'estimate' then year(period_end) else -year(period_end) end, case when nature = 'estimate' then fact else -fact end) as rn from facts where metric_key = 'score.piotroski.total')
select stock, fact, year, nature from f where (nature = 'estimate' and rn <= 2) or (nature <> 'estimate' and rn <= 5)""")
def w13_compared_years(spark, sf):
    return P.compared_years(_facts(spark, sf).where("metric_key = 'score.piotroski.total'")).select("stock", "fact", F.year("period_end").cast("long").alias("year"), "nature")


_ONE = "arg_max(value, (period_end, created, fact)) filter (metric_key = '{}')"


@query(f"""with {_SQL_FACTS}, {_SQL_STOCKS}, cur as (select * from facts where is_current),
one as (select stock, {_ONE.format("mkt.price")} as price, {_ONE.format("val.pe")} as pe, {_ONE.format("owners_earnings_per_share_normalized")} as oeps_normalized, {_ONE.format("rates.sales.cagr_est")} as gs, {_ONE.format("rates.revenues.cagr_est")} as gr, {_ONE.format("rates.cash_flow.cagr_est")} as gc, {_ONE.format("rates.earnings.cagr_est")} as ge from cur where value is not null group by stock),
ser as (select stock, year(period_end) as y, value, row_number() over (partition by stock order by period_end desc) as back from cur where metric_key = 'owners_earnings_per_share' and period_type = 'FY'),
inp as (select stock, year(period_end) as y, max(value) filter (metric_key = 'per_share.eps') as eps, max(value) filter (metric_key = 'is.depreciation') as dep, max(value) filter (metric_key = 'equity.shares_outstanding') as shares, max(value) filter (metric_key = 'per_share.capital_spending') as capex from cur where period_type = 'FY' group by all),
e as (select ser.stock, ser.y, back, coalesce(ser.value, 0) as v, eps, capex, case when shares > 0 then coalesce(dep, 0) / shares else 0 end as d, shares > 0 and dep is not null as computed from ser left join inp on inp.stock = ser.stock and inp.y = ser.y where back <= 6),
s6 as (select stock, string_agg(y || ':' || (eps is not null)::int || (capex is not null)::int || coalesce(computed, false)::int, ',' order by back) as series, sum(v + coalesce(eps, 0) * 2 + coalesce(capex, 0) * 3 + d * 5) as digest, arg_max(v, -back) as first from e group by stock),
med as (select stock, y, row_number() over (partition by stock order by v, y) as i, count(*) over (partition by stock) as n from e where back <= 5),
g as (select stock, unnest([1, 2, 3]) as i, unnest([case when gs is not null then 'sales' else 'revenues' end, 'cash_flow', 'earnings']) as key, unnest([coalesce(gs, gr), gc, ge]) * 100 as value from one),
gg as (select stock, string_agg(key, ',' order by i) as growth, arg_min(key, (value, i)) as growth_default from g where value is not null group by stock),
lp as (select stock, coalesce(arg_max(close, created) filter (day = date '2024-01-15'), arg_max(close, (day, created))) as latest_price, coalesce(max(day) filter (day = date '2024-01-15'), max(day)) as latest_price_date from prices group by stock)
select st.stock, ticker, coalesce(listing_exchange, exchange) as exchange, company, actives.document as active_document, actives.report_date as active_date, price, pe, oeps_normalized, latest_price, latest_price_date, coalesce(series, '') as series, round(digest, 6) as digest,
  med.y as dcf_year, coalesce(growth, '') as growth, growth_default, round(coalesce(oeps_normalized, first), 3) as based_on
from stocks st left join one using (stock) left join s6 using (stock) left join med on med.stock = st.stock and med.i = med.n // 2 + 1 left join gg on gg.stock = st.stock left join lp on lp.stock = st.stock left join actives on actives.stock = st.stock""")
def q07_stock_pages(spark, sf):
    out = P.stock_pages(_stocks(spark, sf), _facts(spark, sf), _prices(spark, sf), _docs(spark, sf), F.lit(datetime.date(2024, 1, 15)))
    flag = lambda c, word="fact": (c == word).cast("int").cast("string")
    series = F.array_join(F.transform("series", lambda x: F.concat(x["year"].cast("string"), F.lit(":"), flag(x["eps_source"]), flag(x["capex_source"]), flag(x["depreciation_source"], "computed"))), ",")
    digest = F.aggregate("series", F.lit(0.0), lambda a, x: a + (x["value"] + x["eps"] * 2 + x["capex"] * 3 + x["depreciation"] * 5))
    out = out.withColumns({"digest": F.when(F.size("series") > 0, F.round(digest, 6)), "series": F.coalesce(series, F.lit("")), "growth": F.coalesce(F.array_join(F.transform("growth", lambda g: g["key"]), ","), F.lit(""))})
    return out.withColumn("dcf_year", F.col("dcf_year").cast("long"))


@query(f"""with {_SQL_FACTS}, {_SQL_STOCKS}, c as (select stock, count(*) as n from facts where is_current group by stock)
select lower(ticker) as ticker, arg_max(st.stock, ((a.stock is not null)::int, coalesce(a.report_date, date '0001-01-01'), coalesce(n, 0), is_active::int, -st.stock)) as stock from stocks st left join actives a on a.stock = st.stock left join c on c.stock = st.stock group by all""")
def a15_stock_for_ticker(spark, sf):
    return P.stock_for_ticker(_stocks(spark, sf), _facts(spark, sf), _docs(spark, sf))


@query(f"""with {_SQL_FACTS}, {_SQL_STOCKS}, pg as (select l_suppkey * 3 + l_linenumber % 5 as document, count(*) as n from lineitem group by all),
x as (select o_custkey as document, count(distinct o_orderkey % 9) as n, max('v' || o_orderkey % 3) as version from orders group by all),
nm as (select distinct document, stock from (select document, stock from facts where source_type = 'parsed' and document is not null union all select document, stock from docs where stock is not null)),
co as (select nm.document, list(ticker order by ticker) as companies from nm join stocks using (stock) group by all), ac as (select a.document, list(ticker order by ticker) as active_for from actives a join stocks using (stock) group by all)
select d.document, d.report_date, case when version = 'v1' then 'Report (v1)' else coalesce(nullif(source, ''), 'Unknown') end as template, coalesce(pg.n, 0) as page_count, coalesce(x.n, 0) as parsed_page_count, coalesce(array_to_string(companies, ','), '') as companies, coalesce(array_to_string(active_for, ','), '') as active_for,
  active_for is not null as is_active_report, coalesce(companies[1], '~') as sort_ticker from docs d left join pg using (document) left join x using (document) left join co using (document) left join ac using (document)""")
def q15_document_list(spark, sf):
    pages = A.table(spark, sf, "lineitem").select((F.col("l_suppkey") * 3 + F.col("l_linenumber") % 5).alias("document"))
    found = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("document"), (F.col("o_orderkey") % 9).alias("page"), F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")).alias("version"))
    out = P.document_list(_docs(spark, sf), pages, found, _facts(spark, sf), _stocks(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("companies", "active_for")})


@query(f"""with {_SQL_FACTS} select fact, stock, metric_key, value, period_end, source_type from facts where is_current and ((source_type = 'parsed' and "user" in (0, 2)) or ("user" = 0 and source_type in ('manual', 'calculated')))""")
def q17_fact_list(spark, sf):
    f = _facts(spark, sf)
    return f.where(F.col("is_current") & DOC.visible(F.col("user"), F.col("source_type"), 0, [2])).select("fact", "stock", "metric_key", "value", "period_end", "source_type")


# institutions

_MANAGERS = "managers as (select s_suppkey as manager, s_name as name, case when s_suppkey % 9 <> 4 then s_suppkey::varchar end as cik, case when s_suppkey % 7 = 2 then 'candidate' else 'confirmed' end as match_status, s_suppkey % 3 <> 1 as is_superinvestor from supplier)"
_FILED = """filed as (select o_orderkey as filing, o_custkey % (select count(*) from supplier) + 1 as manager, last_day(date_trunc('quarter', o_orderdate)::date + interval 2 month) as period, o_orderdate as filed_at from orders),
ranked as (select *, row_number() over (partition by manager, period order by filed_at, filing) = count(*) over (partition by manager, period) as is_latest from filed)"""
_CODES = "codes as (select p_partkey as code, case when p_partkey % 10 <> 0 then p_brand end as ticker, p_partkey % 4 <> 1 as is_active from part)"


def _managers(spark, sf):
    k = F.col("s_suppkey")
    return A.table(spark, sf, "supplier").select(k.alias("manager"), F.col("s_name").alias("name"), F.when(k % 9 != 4, k.cast("string")).alias("cik"), F.when(k % 7 == 2, "candidate").otherwise("confirmed").alias("match_status"), (k % 3 != 1).alias("is_superinvestor"))


def _filed(spark, sf):
    n = A.table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    o = A.table(spark, sf, "orders").join(F.broadcast(n), F.lit(True))  # one number
    rows = o.select(F.col("o_orderkey").alias("filing"), (F.col("o_custkey") % F.col("n") + 1).alias("manager"), D.quarter_end(D.quarter_label(F.col("o_orderdate"))).alias("period"), F.col("o_orderdate").alias("at"))
    from tallyspark.operators import latest as L

    return L.versions(rows, ["manager", "period"], "at", "filing").select("filing", "manager", "period", "is_latest")


def _held(spark, sf):
    li = A.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("filing"), F.col("l_partkey").alias("code"), F.when(F.col("l_partkey") % 10 != 0, F.col("l_suppkey")).alias("stock"), F.when(F.col("l_linenumber") == 3, "PUT").alias("put_call"), F.col("l_quantity").alias("shares"))


def _codes(spark, sf):
    k = F.col("p_partkey")
    return A.table(spark, sf, "part").select(k.alias("code"), F.when(k % 10 != 0, F.col("p_brand")).alias("ticker"), (k % 4 != 1).alias("is_active"))


@query(f"with {_MANAGERS}, {_FILED} select filing, manager, period, is_latest, cik, name from ranked join managers using (manager) where match_status = 'confirmed' and cik is not null and period between date '1997-04-01' and date '1997-06-30'")
def q11_filings_of_quarter(spark, sf):
    return P.filings_of(_managers(spark, sf), _filed(spark, sf), F.lit("1997-q2"))


@query(f"""with {_MANAGERS}, {_FILED}, {_CODES} select l_orderkey as filing, manager, cik, l_partkey as code, case when is_active then ticker end as ticker, l_quantity as shares from lineitem join ranked on filing = l_orderkey join managers using (manager) left join codes on code = l_partkey
where match_status = 'confirmed' and cik is not null and is_latest""")
def q11_holdings(spark, sf):
    return P.holdings_of(_managers(spark, sf), _filed(spark, sf), _held(spark, sf), _codes(spark, sf)).select("filing", "manager", "cik", "code", "ticker", "shares")


@query(f"""with {_MANAGERS}, {_FILED}, {_CODES}, one as (select upper(ticker) as ticker, min(code) as code from codes where is_active and ticker is not null group by all)
select distinct one.ticker, manager from one join lineitem on l_partkey = code join ranked on filing = l_orderkey join managers using (manager) where is_latest and match_status = 'confirmed' and cik is not null""")
def q11_holders(spark, sf):
    return P.holders_of(_managers(spark, sf), _filed(spark, sf), _held(spark, sf), _codes(spark, sf))


@query(f"""with {_MANAGERS}, {_FILED}, a as (select l_suppkey as stock, (period - greatest(isodow(period) - 5, 0)::int)::date as target, max(period) as period from lineitem join ranked on filing = l_orderkey join managers using (manager)
  where l_partkey % 10 <> 0 and l_linenumber <> 3 and is_latest and match_status = 'confirmed' and cik is not null and is_superinvestor group by all),
have as (select distinct user_id as stock, (ts::date - interval (event_id % 3000) day)::date as day from events)
select a.stock, a.target, a.period, case when have.stock is null then 'missing' else 'up_to_date' end as status from a left join have on have.stock = a.stock and have.day = a.target""")
def j23_price_targets(spark, sf):
    prices = A.table(spark, sf, "events").select(F.col("user_id").alias("stock"), F.date_sub(F.to_date("ts"), (F.col("event_id") % 3000).cast("int")).alias("day"))
    return P.price_targets(_managers(spark, sf), _filed(spark, sf), _held(spark, sf), prices)


@query("""with b as (select user_id as symbol, event_id as i, timezone('America/New_York', timezone('UTC', ts))::date as day, case when event_id % 3 <> 0 then value end as c, value + 1 as o from events),
n as (select *, row_number() over (partition by symbol order by i) as place, count(*) over (partition by symbol) as m from b),
f as (select symbol, arg_min(c, place) as close, arg_min(case when place <= m - 40 then o else c end, place) as open, arg_min(case when place <= m - 40 then 5.0::double else 0 end, place) as volume from n where day = date '2024-01-20' and c is not null group by symbol)
select symbol, open, close as high, close as low, close, volume from f""")
def s17_picked_bars(spark, sf):
    e = A.table(spark, sf, "events").groupBy(F.col("user_id").alias("symbol")).agg(F.sort_array(F.collect_list(F.struct("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "value"))).alias("a"))
    short = F.slice("a", 1, F.greatest(F.size("a") - 40, F.lit(0)))
    quote = F.struct(F.transform(short, lambda x: x["value"] + 1).alias("open"), F.transform("a", lambda x: F.when(x["event_id"] % 3 != 0, x["value"])).alias("close"), F.transform(short, lambda x: F.lit(5.0)).alias("volume"))
    payload = F.struct(F.struct(F.array(F.struct(F.transform("a", lambda x: x["ts"]).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    charts = e.select("symbol", F.to_json(payload, {"ignoreNullFields": "false"}).alias("j"))
    return P.picked_bars(charts, "symbol", "j", F.lit(datetime.date(2024, 1, 20)))
