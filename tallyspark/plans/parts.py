"""Queries of single functions and readers over texts made from the driver's tables; their twins go back to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import dates as D
from tallyspark.functions import numbers as N
from tallyspark.functions import text as X
from tallyspark.operators import documents as DOC
from tallyspark.operators import filings as FI
from tallyspark.sources import filings as SRC

from . import analog as A
from .registry import query

# readers


@query("""select case o_orderkey % 3 when 0 then '13F-HR' when 1 then '13F-HR/A' end as form, c_name || ' Fund,  L.P.' as company, lpad(c_custkey::varchar, 10, '0') as cik, o_orderdate::date as filed,
  lpad(o_orderkey::varchar, 10, '0') || '-' || lpad((year(o_orderdate) % 100)::varchar, 2, '0') || '-' || lpad(c_custkey::varchar, 6, '0') as accession from orders join customer on c_custkey = o_custkey where o_orderkey % 3 < 2 and o_orderkey % 7 <> 3""")
def s04_form_index(spark, sf):
    o = A.table(spark, sf, "orders").join(A.table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey")
    form = F.when(k % 3 == 0, "13F-HR").when(k % 3 == 1, "13F-HR/A").otherwise("10-K")
    day = F.when(k % 7 == 3, "2024-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cik = F.col("c_custkey").cast("string")
    path = F.concat(F.lit("edgar/data/"), cik, F.lit("/"), F.lpad(k.cast("string"), 10, "0"), F.lit("-"), F.date_format("o_orderdate", "yy"), F.lit("-"), F.lpad(cik, 6, "0"), F.lit(".txt"))
    line = F.concat(F.rpad(form, 12, " "), F.rpad(F.concat("c_name", F.lit(" Fund,  L.P.")), 62, " "), F.rpad(cik, 12, " "), day, F.lit("  "), path, F.lit("   "))
    head = spark.createDataFrame([("Form Type   Company Name     CIK     Date Filed  File Name",), ("-" * 80,)], "value string")
    return SRC.form_index(head.unionByName(o.select(line.alias("value")))).select("form", "company", "cik", "filed", "accession")


@query("""select l_orderkey as filing, p_name || ' & <Sons> ''' || l_linenumber as issuer, upper('ab' || lpad(l_partkey::varchar, 7, '0')) as cusip, floor(l_extendedprice)::bigint as value, l_quantity::bigint as shares, case l_linenumber % 2 when 0 then 'SH' else 'PRN' end as share_type,
  case l_linenumber % 3 when 1 then 'Put' end as put_call, l_linenumber::bigint as voting_sole, 0::bigint as voting_shared, l_suppkey as voting_none,
  sha256(concat_ws('|', upper('ab' || lpad(l_partkey::varchar, 7, '0')), upper(p_name || ' & <Sons> ''' || l_linenumber), '__NULL__', floor(l_extendedprice)::bigint, l_quantity::bigint, case l_linenumber % 2 when 0 then 'SH' else 'PRN' end, case l_linenumber % 3 when 1 then 'PUT' else '__NULL__' end, 'SOLE', l_linenumber, 0, l_suppkey)) as fingerprint
from lineitem join part on p_partkey = l_partkey""")
def s05_holdings_xml(spark, sf):
    rows = A.table(spark, sf, "lineitem").join(A.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    n = F.col("l_linenumber")
    tag = lambda name, c: F.concat(F.lit(f"<ns1:{name}>"), text(c), F.lit(f"</ns1:{name}>"))
    amounts = F.concat(tag("sshPrnamt", F.col("l_quantity").cast("long")), tag("sshPrnamtType", F.when(n % 2 == 0, "SH").otherwise("PRN")))
    holding = F.concat(
        tag("nameOfIssuer", F.concat("p_name", F.lit(" &amp; &lt;Sons&gt; &#39;"), n.cast("string"))), tag("cusip", F.concat(F.lit("ab"), F.lpad(text("l_partkey"), 7, "0"))), tag("value", F.floor("l_extendedprice")),
        F.when(n % 2 == 0, amounts).otherwise(tag("shrsOrPrnAmt", amounts)), tag("putCall", F.when(n % 3 == 1, "Put").otherwise("")), tag("investmentDiscretion", F.lit("sole")), tag("votingAuthority", F.concat(tag("Sole", n), tag("Shared", F.lit(0)), tag("None", F.col("l_suppkey")))),
    )
    docs = rows.groupBy(F.col("l_orderkey").alias("filing")).agg(F.concat(F.lit('<?xml version="1.0"?><ns1:informationTable xmlns:ns1="urn:x">'), F.array_join(F.collect_list(tag("infoTable", holding)), "\n"), F.lit("</ns1:informationTable>")).alias("xml"))
    out = SRC.holdings_xml(docs, "filing", "xml").drop("title", "discretion")
    return out.withColumns({c: F.col(c).cast("long") for c in ("value", "shares", "voting_sole", "voting_shared", "voting_none")})


@query("""select o_orderkey as filing, last_day(date_trunc('quarter', o_orderdate)::date + interval 2 month) as period, case when o_orderkey % 2 = 0 then '13F-HR' else '13F-HR/A' end as form, o_orderkey % 2 = 0 and o_orderkey % 3 = 0 as amendment, case when o_orderkey % 2 = 0 then floor(o_totalprice)::bigint end as total_value from orders""")
def s06_cover_page(spark, sf):
    o = A.table(spark, sf, "orders")
    end = D.quarter_end(D.quarter_label(F.col("o_orderdate")))
    xml = F.concat(
        F.lit("<x:edgarSubmission><x:submissionType>13F-HR</x:submissionType><x:periodOfReport>"), F.date_format(end, "MM-dd-yyyy"), F.lit("</x:periodOfReport><isAmendment>"), F.when(F.col("o_orderkey") % 3 == 0, "true").otherwise("false"),
        F.lit("</isAmendment><tableValueTotal>"), F.floor("o_totalprice").cast("string"), F.lit("</tableValueTotal></x:edgarSubmission>"),
    )
    sgml = F.concat(F.lit("<SEC-HEADER>\nCONFORMED SUBMISSION TYPE:\t13F-HR/A\nCONFORMED PERIOD OF REPORT:\t"), F.date_format(end, "yyyyMMdd"), F.lit("\n"))
    docs = o.select(F.col("o_orderkey").alias("filing"), F.when(F.col("o_orderkey") % 2 == 0, xml).otherwise(sgml).alias("t"))
    return SRC.cover_page(docs, "filing", "t").withColumn("total_value", F.col("total_value").cast("long"))


@query("select o_custkey as manager, 'a' || o_orderkey as accession, '13F-HR' as form, o_orderdate::date as filed from orders where o_orderkey % 4 = 1")
def s07_submissions(spark, sf):
    o = A.table(spark, sf, "orders").withColumn("form", F.when(F.col("o_orderkey") % 4 == 1, "13F-HR").otherwise("8-K"))
    lists = o.groupBy(F.col("o_custkey").alias("manager")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "form", "o_orderdate"))).alias("a"))
    recent = F.struct(F.transform("a", lambda x: F.concat(F.lit("a"), x["o_orderkey"].cast("string"))).alias("accessionNumber"), F.transform("a", lambda x: x["form"]).alias("form"), F.transform("a", lambda x: F.date_format(x["o_orderdate"], "yyyy-MM-dd")).alias("filingDate"))
    docs = lists.select("manager", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("j"))
    return SRC.submissions(docs, "manager", "j")


# names, notes and figures


@query("""select c_custkey, 'Berkshire ' || c_custkey as company, lpad(c_custkey::varchar, 10, '0') as cik, case c_custkey % 4 when 0 then 'CA' when 1 then 'US' when 2 then 'US' else 'UNKNOWN' end as country,
  case c_custkey % 3 when 0 then 'raised' when 1 then 'lowered' end as kind, case when c_custkey % 3 < 2 then make_date(2023, 1 + (c_custkey % 12)::int, 1 + (c_custkey % 28)::int) end as day,
  case c_custkey % 5 when 0 then -(c_custkey * 1000 + 234)::double when 1 then -(c_custkey::double + 0.5) when 2 then null when 3 then c_custkey::double + 0.9 else -c_custkey::double end as figure, 'Societe Generale ' || c_custkey as folded, 'Return On Equity' as label from customer""")
def x02_names_and_figures(spark, sf):
    k = F.col("c_custkey")
    t = k.cast("string")
    company = X.company_part(F.concat(F.lit("Warren B - "), F.lit("Berkshire "), t))
    cik = X.name_and_cik(F.concat(F.lit("Some Name (CIK "), t, F.lit(") more")))["cik"]
    country = X.market_country(F.when(k % 4 == 1, "NYSE").when(k % 4 == 2, " nasdaq "), F.when(k % 4 == 0, F.concat(t, F.lit(".to"))).otherwise(t))
    day = F.concat((1 + k % 12).cast("string"), F.lit("/"), (1 + k % 28).cast("string"), F.lit("/23"))
    event = X.rating_event(F.when(k % 3 == 0, F.concat(F.lit("Raised "), day)).when(k % 3 == 1, F.concat(F.lit("TIMELINESS lowered "), day)).otherwise("unchanged"))
    whole = F.format_number(k * 1000 + 234, 0)
    figure = X.accounting_number(F.when(k % 5 == 0, F.concat(F.lit("("), whole, F.lit(")"))).when(k % 5 == 1, F.concat(F.lit("d"), t, F.lit(".5"))).when(k % 5 == 2, "NMF").when(k % 5 == 3, F.concat(F.lit(" $"), t, F.lit(".q"))).otherwise(F.concat(F.lit("-"), t)))
    return A.table(spark, sf, "customer").select("c_custkey", company.alias("company"), cik.alias("cik"), country.alias("country"), event["kind"].alias("kind"), event["day"].alias("day"), figure.alias("figure"), X.folded(F.concat(F.lit("Société Générale "), t)).alias("folded"), X.label_of(F.lit("bs.return_on_equity")).alias("label"))


# days


@query("""with d as (select o_orderkey, o_orderdate::date as d, last_day(date_trunc('quarter', o_orderdate)::date + interval 2 month) as q from orders),
e as (select *, (1 + o_orderkey % 12)::int as m, (d + (o_orderkey % 130)::int)::date as today from d),
u as (select e.*, (select max(x.q) from (select last_day((date_trunc('quarter', today) - to_months(3 * i) + interval 2 month)::date) as q from range(0, 5) r(i)) x where x.q + 45 <= today) as usable, last_day(make_date(year(today) - 1, m, 1)) + 45 as due1, last_day(make_date(year(today), m, 1)) + 45 as due from e)
select o_orderkey, case when today <= q then 'pre_window' when today <= q + 45 then 'filing_window_open' else 'post_deadline' end as phase, case when q + 45 <= today then 'actual' else 'estimate' end as nature, year(usable) || '-Q' || quarter(usable) as usable,
  year(d) || '-Q' || quarter(d) || ',' || year(d - interval 3 month) || '-Q' || quarter(d - interval 3 month) as last_two,
  case when today < due1 then year(today) - 1 when today < due then year(today) else year(today) + 1 end as estimate_year, last_day(make_date(case when o_orderkey % 4 < 3 then year(d) - 1 else year(d) end, [6, 9, 12, 3][1 + (o_orderkey % 4)::int], 1)) as fiscal_end,
  case when o_orderkey % 5 = 3 then last_day(d) when o_orderkey % 5 = 4 then null else d end as parsed from u""")
def d05_quarter_functions(spark, sf):
    k, d = F.col("o_orderkey"), F.col("d")
    o = A.table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate")).withColumn("q", D.quarter_end(D.quarter_label(F.col("d")))).withColumn("today", F.date_add("d", (k % 130).cast("int")))
    months = F.array(*map(F.lit, (6, 9, 12, 3)))
    fmt = lambda f: F.date_format(d, f)
    written = F.when(k % 5 == 0, fmt("yyyy-MM-dd")).when(k % 5 == 1, fmt("MM-dd-yyyy")).when(k % 5 == 2, fmt("MMMM d, yyyy")).when(k % 5 == 3, F.when(F.year("d") >= 2000, fmt("MM/yy")).otherwise(F.date_format(F.last_day("d"), "MM-dd-yyyy"))).otherwise("soon")
    return o.select(
        "o_orderkey", D.quarter_phase(F.col("q"), F.col("today")).alias("phase"), D.quarter_nature(F.col("q"), F.col("today")).alias("nature"), D.latest_usable_quarter(F.col("today")).alias("usable"), F.array_join(D.last_quarters(D.quarter_label(d), 2), ",").alias("last_two"),
        D.first_estimate_year(F.col("today"), (1 + k % 12).cast("int")).cast("long").alias("estimate_year"), D.fiscal_quarter_end(F.year("d"), (k % 4 + 1).cast("int"), months).alias("fiscal_end"), D.parse_day(written).alias("parsed"),
    )


@query("""with e as (select event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as was, timezone('America/New_York', timezone('UTC', ts)) as l, value from events),
m as (select *, case when isodow(l) >= 6 or hour(l) * 60 + minute(l) < 990 then ((l::date - 1) - greatest(isodow(l::date - 1) - 5, 0)::int)::date else l::date end as day from e)
select event_id, case when epoch(date_trunc('second', ts)) - epoch(date_trunc('second', was)) < 600 then 'throttled' when was::date >= day then 'up_to_date' when value > 5 then 'refreshed' else 'failed' end as decision,
  case when value >= 20 then 20.0 when value > 0 then value else null end as chosen from m""")
def d15_refresh_decision(spark, sf):
    from pyspark.sql import Window

    e = A.table(spark, sf, "events").withColumn("was", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    decision = D.refresh_decision(F.col("ts"), F.col("was"), F.to_date("was"), F.col("value") > 5)
    v = F.col("value")
    return e.select("event_id", decision.alias("decision"), N.first_nonzero(F.when(v >= 20, 20.0).otherwise(0.0), F.when((v > 0) & (v < 20), v)).alias("chosen"))


# checks, coverage, lineage


@query("""with dup as (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1), bad as (select o_orderkey from orders where o_totalprice < 5000),
i as (select 'duplicates' as check_, 'error' as severity from dup union all select 'totals', 'warning' from bad)
select count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, 3 - count(distinct check_) as infos, case when count(*) filter (severity = 'error') > 0 then 'failed' when count(*) > 0 then 'warning' else 'passed' end as status from i""")
def a23_quality_report(spark, sf):
    dup = FI.duplicates(A.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    bad = A.table(spark, sf, "orders").where("o_totalprice < 5000")
    found = FI.issues("duplicates", "error", dup, "l_orderkey", "n").unionByName(FI.issues("totals", "warning", bad, "o_orderkey", "o_totalprice"))
    return FI.report(found, ["duplicates", "totals", "dates"])


@query("""with j as (select event_id as job, event_type as kind, user_id as lock_key, case when value < 40 then 'failed' when value < 40.05 then 'succeeded' else 'skipped' end as status, ts - interval 1 day * (event_id % 3) as finished_at from events),
w as (select *, count(*) filter (status = 'failed') over (partition by lock_key, kind) as tried, bool_or(status in ('queued', 'running', 'succeeded')) over (partition by lock_key, kind) as busy from j),
r as (select *, row_number() over (partition by lock_key, kind order by finished_at desc, job desc) as rn from w where status = 'failed' and not busy and tried <= 50 and epoch(timestamp '2024-01-20 00:00:00') - epoch(date_trunc('second', finished_at)) >= 86400 and kind in ('click', 'view'))
select job, kind, lock_key || '/' || kind as lock_key from r where rn = 1""")
def g11_retries(spark, sf):
    v = F.col("value")
    status = F.when(v < 40, "failed").when(v < 40.05, "succeeded").otherwise("skipped")
    j = A.table(spark, sf, "events").select(F.col("event_id").alias("job"), F.col("event_type").alias("kind"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("lock_key"), status.alias("status"), (F.col("ts").cast("timestamp") - F.make_dt_interval(days=(F.col("event_id") % 3).cast("int"))).alias("finished_at"))
    return FI.retries(j, F.lit("2024-01-20 00:00:00").cast("timestamp"), ["click", "view"], 50)


@query("""with e as (select o_orderkey as extraction, o_custkey as document, o_orderpriority as metric_key, case when o_orderkey % 3 > 0 then year(o_orderdate) end as p from orders),
f as (select l_orderkey * 10 + l_linenumber as fact_id, any_value(o_custkey) as document, min(o_orderpriority) as metric_key, min(case when l_linenumber % 2 = 0 then year(l_shipdate) end) as period_end, min(case when l_linenumber = 1 and l_orderkey % 2 = 0 then l_orderkey end) as ref from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey, l_linenumber)
select fact_id, ref as extraction from f where ref is not null union all
select fact_id, max(extraction) from f join e using (document, metric_key) where ref is null and (period_end is null or p is null or p = period_end) group by fact_id""")
def j20_lineage(spark, sf):
    o, li = A.table(spark, sf, "orders"), A.table(spark, sf, "lineitem")
    found = o.select(F.col("o_orderkey").alias("extraction"), F.col("o_custkey").alias("document"), F.col("o_orderpriority").alias("metric_key"), F.when(F.col("o_orderkey") % 3 > 0, F.year("o_orderdate")).alias("period_end"))
    n = F.col("l_linenumber")
    facts = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_orderkey", "l_linenumber").agg(
        F.min("o_custkey").alias("document"), F.min("o_orderpriority").alias("metric_key"), F.min(F.when(n % 2 == 0, F.year("l_shipdate"))).alias("period_end"), F.min(F.when((n == 1) & (F.col("l_orderkey") % 2 == 0), F.col("l_orderkey"))).alias("ref")
    )
    return DOC.lineage(facts.withColumn("fact_id", F.col("l_orderkey") * 10 + n), found)


_SIDE = "j{0} as (select user_id as id, max(value) filter (event_id % {1} = 0) as a, count(*) filter (event_id % {1} = 0) as n, min(event_type) as t from events group by all)"


@query(f"""with {_SIDE.format(1, 2)}, {_SIDE.format(2, 3)},
u as (select id, 'a.max' as path, 1 as side, a::varchar as v from j1 union all select id, 'a.max', 2, a::varchar from j2 union all select id, 'n', 1, n::varchar from j1 union all select id, 'n', 2, n::varchar from j2 union all select id, 'l[0]', 1, t from j1 union all select id, 'l[0]', 2, t from j2 union all select id, 'l[1]', 2, n::varchar from j2 where id % 2 = 0)
select id, path, max(v) filter (side = 1) as "left", max(v) filter (side = 2) as "right" from u group by all having max(v) filter (side = 1) is distinct from max(v) filter (side = 2)""")
def n10_json_diff(spark, sf):
    e = A.table(spark, sf, "events")

    def side(k: int, more: bool):
        hit = F.col("event_id") % k == 0
        g = e.groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(hit, F.col("value"))).alias("a"), F.count_if(hit).alias("n"), F.min("event_type").alias("t"))
        items = F.array(F.col("t"), F.when(F.col("id") % 2 == 0, F.col("n").cast("string")))
        return g.select("id", F.to_json(F.struct(F.struct(F.col("a").alias("max")).alias("a"), "n", (F.array_compact(items) if more else F.array("t")).alias("l"))).alias("j"))

    return DOC.diff(side(2, False), side(3, True), "id", "j")


@query("""with k as (select distinct p_type || '.' || p_size as metric_key from part)
select metric_key, case when metric_key in ('ECONOMY.1', 'SMALL.2', 'PROMO.3') then 'exact' when regexp_full_match(metric_key, 'SMALL\\.[0-9]+') or regexp_full_match(metric_key, '.*\\.4[0-9]') then 'templated' else 'uncovered' end as coverage from k""")
def n19_coverage(spark, sf):
    keys = A.table(spark, sf, "part").select(F.concat_ws(".", "p_type", F.col("p_size").cast("string")).alias("metric_key")).distinct()
    return DOC.coverage(keys, ["ECONOMY.1", "SMALL.2", "PROMO.3"], [r"SMALL\.[0-9]+", r".*\.4[0-9]"])
