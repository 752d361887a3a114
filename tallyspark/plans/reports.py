"""Queries over texts and nested reports made from the driver's tables, and their DuckDB twins, which go back to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import series as SE
from tallyspark.operators import latest as L
from tallyspark.operators import revisions as RV
from tallyspark.operators import spec as SP
from tallyspark.streaming import requests as RQ

from . import analog as A
from .registry import query

# years and series

_SEPARATORS = ["", " ", ", ", " (est) ", " no longer in one run "]


@query("""with t as (select o_custkey as c, o_orderkey as k, 2000 + o_orderkey % 23 as y, ['', ' ', ', ', ' (est) ', ' no longer in one run '][1 + (o_orderkey // 3) % 17 % 5] as sep from orders),
g as (select *, coalesce(length(lag(sep) over w) + 4 > 12, true) as cut from t window w as (partition by c order by k)),
r as (select *, sum(cut::int) over (partition by c order by k) as run from g),
u as (select c, run, count(*) as n, count(distinct y) as n_years from r group by all having count(*) >= 6),
b as (select c, arg_max(run, (n_years, n, -run)) as run from u group by c),
f as (select c, y, min(k) as k from r join b using (c, run) group by all),
s as (select c, string_agg(y::varchar, ',' order by k) as years from f group by c)
select c_custkey, coalesce(years, '') as years from (select distinct o_custkey as c_custkey from orders) left join s on c = c_custkey""")
def x18_year_runs(spark, sf):
    o = A.table(spark, sf, "orders")
    sep = F.get(F.array(*map(F.lit, _SEPARATORS)), (F.floor(F.col("o_orderkey") / 3) % 17 % 5).cast("int"))
    piece = F.concat((2000 + F.col("o_orderkey") % 23).cast("string"), sep)
    texts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", piece.alias("p")))), lambda x: x["p"]), "").alias("text"))
    return texts.select("c_custkey", F.array_join(SE.year_run(F.col("text")), ",").alias("years"))


#: sums of a supplier's years from 1995 on, as whole numbers
_YEARLY = "y as (select l_suppkey as s, year(l_shipdate) as y, sum(l_quantity)::bigint as q, sum(l_linenumber)::bigint as n from lineitem group by all)"


def _yearly(spark, sf):
    y = A.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").cast("long").alias("q"), F.sum("l_linenumber").alias("n"))
    return y.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("y", "q", "n"))).alias("a"))


@query(f"""with {_YEARLY}, r as (select *, row_number() over (partition by s order by y) as i, count(*) over (partition by s) as m from y),
k as (select *, case s % 4 when 0 then m when 1 then m - 1 when 2 then m - 3 else m + 1 end as given from r),
v as (select s, y + 10 as year, case when s % 4 = 0 then q when s % 4 = 1 then (case when i < m then q end) when s % 4 = 2 then (case when i > 3 then lag(q, 3) over (partition by s order by y) end) else q end as q from k where m >= 6)
select s, year, case when q % 5 = 0 then null else q / 100.0 end as value, (s % 90)::double as projection from v""")
def x18_labelled_series(spark, sf):
    rows = _yearly(spark, sf)
    year = F.array_join(F.transform("a", lambda x: (x["y"] + 10).cast("string")), "")
    words = F.transform("a", lambda x: F.when(x["q"] % 5 == 0, "NMF").otherwise(F.format_string("%.2f", x["q"] / 100.0)))
    m = F.size("a")
    kept = F.when(F.col("s") % 4 == 0, words).when(F.col("s") % 4 == 1, SE.first(words, m - 1)).when(F.col("s") % 4 == 2, SE.first(words, m - 3)).otherwise(F.concat(F.array(F.lit("77.5")), words))
    text = F.concat(year, F.lit("B other text\n12.5 Revenues "), F.array_join(kept, " "), F.lit("  SalesperSh "), (F.col("s") % 90).cast("string"), F.lit(" end"))
    out = SE.labelled_series(rows.where(m >= 6).withColumn("text", text), "text", "SalesperSh")
    return out.select("s", "projection", F.inline(F.arrays_zip(F.col("years").alias("year"), F.col("series").alias("value")))).select("s", F.col("year").cast("long").alias("year"), "value", "projection")


@query(f"""with {_YEARLY}, r as (select *, row_number() over (partition by s order by y) as i, count(*) over (partition by s) as m from y),
a as (select s, 'quantity' as series, y::varchar as key, case when i <= m - s % 3 then q end as value, i, m from r union all select s, 'lines', y::varchar, case when s % 2 = 0 and i > 2 then n end, i, m from r),
k as (select s, series, key, value::double as value from a where not (i = m and value is null)
  union all select distinct s, 'quantity', 'projection', (s * 2)::double from r where s % 5 <> 0),
f as (select *, bool_or(value is not null) over (partition by s, series) as there from k)
select s, series, key, value from f where there""")
def n07_year_maps(spark, sf):
    rows = _yearly(spark, sf)
    quantity = SE.first(F.transform("a", lambda x: x["q"].cast("double")), F.size("a") - (F.col("s") % 3).cast("int"))
    lines = F.transform("a", lambda x, i: F.when((F.col("s") % 2 == 0) & (i >= 2), x["n"].cast("double")))
    projection = F.when(F.col("s") % 5 != 0, F.col("s") * 2)
    maps = SE.group_year_maps({"q": quantity, "lines": lines}, F.transform("a", lambda x: x["y"]), {"q": projection}, {"q": "quantity"}, drop_all_null=True, drop_trailing_null=True)
    return rows.select("s", F.explode(maps).alias("series", "m")).select("s", "series", F.explode("m").alias("key", "value"))


@query("""with t as (select l_suppkey as s, l_returnflag as f, l_linestatus as st, year(l_shipdate) as y, sum(l_quantity)::bigint as q from lineitem where year(l_shipdate) between 1996 and 1998 group by all),
l as (select distinct s, f, st from t), c as (select s, f, st, u.y, q from l cross join (values (1996), (1997), (1998)) u(y) left join t using (s, f, st, y))
select s, 'Flag ' || f || ' (' || st || ')' as row_label, case y when 1998 then '12/31/98' else y::varchar end as column_label, case when q % 7 <> 0 then q / 10.0 end as value, 'ok' as state,
  make_date(case y when 1998 then 2098 else y end, 12, 31) as day from c where q is not null""")
def x15_grid(spark, sf):
    t = A.table(spark, sf, "lineitem").withColumn("y", F.year("l_shipdate")).where("y between 1996 and 1998").groupBy(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("st"))
    t = t.agg(*[F.sum(F.when(F.col("y") == y, F.col("l_quantity"))).cast("long").alias(f"q{y}") for y in (1996, 1997, 1998)])
    cell = lambda q: F.lpad(F.coalesce(F.when(q % 7 == 0, "--").otherwise(F.format_string("%.1f", q / 10.0)), F.lit("")), 12, " ")
    line = F.concat(F.rpad(F.concat(F.lit("Flag "), "f", F.lit(" ("), "st", F.lit(")")), 20, " "), *[cell(F.col(f"q{y}")) for y in (1996, 1997, 1998)])
    text = F.concat(F.lit("CURRENT POSITION\n"), F.lit(" " * 28 + "1996        1997    12/31/98\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"))
    grid = SE.grid(t.groupBy("s").agg(text.alias("text")), "s", "text")
    return grid.select("s", "row_label", "column_label", "value", "state", SE.column_day(F.col("column_label")).alias("day"))


@query("""with t as (select l_suppkey as s, year(l_shipdate) as year, quarter(l_shipdate) as quarter, sum(l_quantity)::bigint as q from lineitem group by all),
w as (select s, year, sum(q) as total, count(*) as n from t group by all),
c as (select s, year, u.quarter, case when q % 6 = 0 then null else q end as q from w cross join (values (1), (2), (3), (4)) u(quarter) left join t using (s, year, quarter)),
o as (select s, year, quarter, ['Jun', 'Sep', 'Dec', 'Mar'][quarter] as month, q::double as value, 'ok' as state from c union all select s, year, null, null, total::double, 'ok' from w where s % 2 = 0)
select s, year, quarter::bigint as quarter, case when s % 3 = 0 then ['Mar', 'Jun', 'Sep', 'Dec'][quarter] else month end as month, case when s % 3 = 0 then 12 else 3 end as fiscal_year_end_month, value, state from o""")
def x17_quarterly(spark, sf):
    t = A.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("year")).agg(*[F.sum(F.when(F.quarter("l_shipdate") == q, F.col("l_quantity"))).cast("long").alias(f"q{q}") for q in (1, 2, 3, 4)], F.sum("l_quantity").cast("long").alias("total"))
    cell = lambda q: F.when(F.col(q) % 6 == 0, "NMF").otherwise(F.coalesce(F.col(q).cast("string"), F.lit("--")))
    line = F.concat(F.col("year").cast("string"), F.lit("  "), F.concat_ws("   ", *[cell(f"q{q}") for q in (1, 2, 3, 4)]), F.when(F.col("s") % 2 == 0, F.concat(F.lit("  "), F.col("total").cast("string"))).otherwise(F.lit("")))
    head = F.when(F.col("s") % 3 == 0, "Cal-endar no months here").otherwise("Cal-endar Jun.Per Sep.30 Dec.31 Mar.31")
    text = F.concat(head, F.lit("\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"))
    out = SE.quarterly(t.groupBy("s").agg(text.alias("text")), "s", "text")
    return out.select("s", F.col("year").cast("long").alias("year"), F.col("quarter").cast("long").alias("quarter"), "month", "fiscal_year_end_month", "value", "state")


# versions, conflicts, budgets


@query("""with e as (select *, json_extract_string(props, '$.k')::bigint as k from events),
v as (select *, case when k % 10 = 0 then null when k % 10 = 1 then 'beta' else 'v' || k end as version, case when k % 10 <= 1 then -1 else k end as rank from e)
select user_id, event_type, arg_max(event_id, (rank, event_id)) as event_id, max(rank) as number from v group by user_id, event_type""")
def w20_newest_version(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    version = F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, "beta").otherwise(F.concat(F.lit("v"), k.cast("string")))
    e = A.table(spark, sf, "events").withColumn("version", version)
    return L.newest_version(e, ["user_id", "event_type"], "version", "event_id").select("user_id", "event_type", "event_id", L.version_number(F.col("version")).cast("long").alias("number"))


@query("""with o as (select l_suppkey as stock, l_partkey as metric, l_quantity as value, l_orderkey as document, l_shipdate::date as day from lineitem),
m as (select stock, metric from o group by all having count(distinct value) > 1),
r as (select *, row_number() over (partition by stock, metric order by day desc, document desc, value desc) as rn from o join m using (stock, metric)),
p as (select stock, metric, max(value) filter (rn = 1) as cv, max(document) filter (rn = 1) as cd, max(day) filter (rn = 1) as cr, max(value) filter (rn = 2) as pv, max(document) filter (rn = 2) as pd, max(day) filter (rn = 2) as pr from r where rn <= 2 group by all)
select stock, metric, cv as current_value, cd as current_document, cr as current_day, pv as previous_value, pd as previous_document, pr as previous_day from p""")
def w24_current_and_previous(spark, sf):
    rows = A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("stock"), F.col("l_partkey").alias("metric"), F.col("l_quantity").alias("value"), F.col("l_orderkey").alias("document"), F.to_date("l_shipdate").alias("day"))
    return RV.actual_conflicts(rows, ["stock", "metric"], "value", "day", "document")


@query("select event_id, count(*) over w as used, greatest(12 - count(*) over w, 0) as remaining from events window w as (order by ts range between interval 3600 seconds preceding and current row)")
def r03_rolling_budget(spark, sf):
    return RQ.rolling_budget(A.table(spark, sf, "events"), "ts", "event_id", 12, 3600).select("event_id", "used", "remaining")


# mapped reports

SPEC = {
    "mappings": [
        {"id": "sales", "json_path": "annual_financials.per_year.*", "metric_key": "is.sales", "value": {"numeric_from": "sales (net)"}, "unit": "USD_millions", "period_type": "FY", "period_end_date": {"derive": "year_end_from_key"}},
        {"id": "lines", "json_path": "annual_financials.per_year.*", "metric_key": "is.lines", "value": {"numeric_from": "lines", "null_as_zero": True}, "period_type": "FY", "period_end_date": {"derive": "year_end_from_key"}},
        {"id": "quarter", "json_path": "quarters[]", "metric_key": "q.sales", "value": {"numeric_from": "sales"}, "unit": "percent", "period_type": "Q", "period_end_date": {"derive": "quarter_end_from_context"}},
        {"id": "rating", "json_path": "header", "metric_key": "rating.word", "value": {"text_from": "rating"}, "period_type": "AS_OF", "period_end_date": {"from": "report_date"}},
        {"id": "position", "json_path": "financial_position.assets[]", "metric_key": "bs.assets", "value": {"numeric_from": "$value"}, "unit": "USD_millions", "period_type": "AS_OF", "period_end_date": {"derive": "financial_position_date_from_index"}},
        {"id": "evidence", "json_path": "header", "metric_key": "rating.seen", "value": {"text_from": "rating"}},
    ]
}
TAXONOMY = {"mapping_semantics": {"rating": {"fact_nature": "opinion"}, "position": {"fact_nature_rule": "none"}, "evidence": {"storage_role": "evidence_only"}}}


@query(f"""with {_YEARLY}, m as (select s, max(y) as newest, 1 + s % 12 as month, bool_or(true) as t from y group by s),
f as (select y.s, last_day(make_date(y, month, 1)) as fye, y, q, n, newest from y join m using (s)),
nat as (select *, case when s % 3 = 0 then (case when y >= newest - 1 then 'estimate' when y < newest - 2 then 'actual' end) when s % 3 = 1 then (case when y = newest then 'estimate' end) else (case when y < newest - 2 then 'actual' when y = newest then 'estimate' end) end as nature from f)
select s, 'is.sales' as metric_key, q * 1e6 as value, null as text, 'FY' as period_type, fye as period_end, nature from nat
union all select s, 'is.lines', case when n % 4 = 0 then 0 else n end, null, 'FY', fye, nature from nat
union all select s, 'q.sales', q::double * 0.01, null, 'Q', last_day(make_date(y, 6, 1)), case when n % 2 = 0 then 'estimate' end from f where n % 3 <> 0
union all select s, 'rating.word', null, 'r' || s, 'AS_OF', date '2002-01-15', 'opinion' from m where s % 5 <> 0
union all select s, 'bs.assets', q * 1e6, null, case when y < 1998 then 'FY' else 'AS_OF' end, case when y < 1998 then make_date(y, 12, 31) else make_date(y, 3, 31) end, null from f where y < 2000""")
def n04_spec_facts(spark, sf):
    rows = _yearly(spark, sf)
    s, newest = F.col("s"), F.element_at(F.col("a"), -1)["y"]
    years = F.transform("a", lambda x: x["y"])
    per_year = F.map_from_entries(F.transform("a", lambda x: F.struct(x["y"].cast("string").alias("key"), F.struct(x["q"].alias("sales (net)"), F.when(x["n"] % 4 != 0, x["n"]).alias("lines")).alias("value"))))
    meta = F.struct(
        (1 + s % 12).alias("fiscal_year_end_month"),
        F.when(s % 3 == 0, F.filter(years, lambda y: y >= newest - 1)).alias("estimate_years"),
        F.when(s % 3 != 1, F.filter(years, lambda y: y < newest - 2)).alias("actual_years"),
        F.when(s % 3 != 0, years).alias("historical_years"),
    )
    quarter = F.transform("a", lambda x: F.struct(x["q"].alias("sales"), F.when(x["n"] % 3 != 0, F.last_day(F.make_date(x["y"], F.lit(6), F.lit(1))).cast("string")).alias("period_end"), F.when(x["n"] % 2 == 0, "estimate").alias("fact_nature")))
    label = F.transform("a", lambda x: F.when(x["y"] < 1998, x["y"].cast("string")).when(x["y"] < 2000, F.make_date(x["y"], F.lit(3), F.lit(31)).cast("string")).otherwise("later"))
    report = F.struct(
        F.struct(F.when(s % 5 != 0, F.concat(F.lit("r"), s.cast("string"))).alias("rating")).alias("header"),
        F.lit("2002-01-15").alias("report_date"),
        F.struct(meta.alias("meta"), per_year.alias("per_year")).alias("annual_financials"),
        quarter.alias("quarters"),
        F.struct(label.alias("years"), F.transform("a", lambda x: x["q"]).alias("assets")).alias("financial_position"),
    )
    docs = rows.select("s", F.to_json(report, {"ignoreNullFields": "false"}).alias("j"))
    facts = SP.facts(docs, "s", "j", SP.compiled(SPEC, TAXONOMY))
    return facts.select("s", "metric_key", "value", "text", "period_type", "period_end", "nature")
