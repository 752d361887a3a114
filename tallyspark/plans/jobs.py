"""Queries of job runs, marked JSON, company lists and nested payloads; their twins go back to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import documents as DOC
from tallyspark.operators import jobs as JOB
from tallyspark.operators import pages as PG
from tallyspark.sources import filings as SRC

from . import analog as A
from .registry import query

_JOBS = """j as (select o_orderkey as job, ['quarterly_pipeline', 'enrich_metadata', 'ingest_quarter', 'ingest_accession'][1 + (o_orderkey % 4)::int] as job_type, case when o_orderkey % 2 = 0 then 'cron' else 'hand' end as trigger,
  case o_orderstatus when 'F' then 'failed' when 'P' then 'partial_success' else 'succeeded' end as status, o_orderdate::timestamp as created_at, case when o_orderkey % 5 > 0 then o_orderdate::timestamp + interval 1 hour end as started_at,
  case when o_orderkey % 3 = 0 then o_orderdate::timestamp + interval 1 hour end as heartbeat_at, case when o_orderkey % 7 > 0 then o_orderdate::timestamp + interval 24 hour end as finished_at, case o_orderkey % 11 when 0 then 'boom' when 1 then '' end as error_message,
  case when o_orderkey % 6 > 0 then year(o_orderdate) || '-Q' || quarter(o_orderdate) end as quarter, o_orderkey % 13 = 0 as broken from orders),
lines as (select l_orderkey as job, l_linenumber as n, l_partkey as p, l_returnflag as flag, case when l_linenumber <> 3 then (l_partkey % 5)::varchar end as accession_no, case when l_linenumber % 2 = 1 then 'e' || l_linenumber when l_linenumber = 2 then '' end as error,
  ['fetch_quarter_index', 'ingest_holdings', 'other', null][1 + l_linenumber % 4] as stage, case l_returnflag when 'R' then 'failed' when 'N' then 'conflict' else 'succeeded' end as stage_status, case when l_linenumber = 1 then 'detail' end as detail, case when l_linenumber <= 2 then 'check' end as check_, case when l_linenumber = 3 then 'error' end as severity
  from lineitem join j on job = l_orderkey where not broken)"""


def job_runs(spark, sf):
    """Orders as job runs; their lines are accessions that failed, issues and stages in a JSON summary, which every thirteenth job has broken."""
    n, flag, key, text = F.col("l_linenumber"), F.col("l_returnflag"), F.col("o_orderkey"), lambda c: c.cast("string")
    failure = F.struct(F.when(n != 3, text(F.col("l_partkey") % 5)).alias("accession_no"), F.when(n % 2 == 1, F.concat(F.lit("e"), text(n))).when(n == 2, "").alias("error"))
    issue = F.struct(F.when(n == 1, "detail").alias("detail"), F.when(n <= 2, "check").alias("check"), F.when(n == 3, "error").alias("severity"))
    stage = F.struct(F.element_at(F.array(F.lit("fetch_quarter_index"), F.lit("ingest_holdings"), F.lit("other"), F.lit(None)), (n % 4 + 1).cast("int")).alias("job_type"), F.when(flag == "R", "failed").when(flag == "N", "conflict").otherwise("succeeded").alias("status"))

    def listed(condition, item):
        return F.transform(F.sort_array(F.collect_list(F.when(condition, F.struct("l_linenumber", "l_partkey", item.alias("x"))))), lambda r: r["x"])

    lines = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(listed(flag == "R", failure).alias("failed_accessions"), listed(flag == "N", issue).alias("issues"), listed(F.lit(True), stage).alias("stages"))
    summary = F.to_json(F.struct("failed_accessions", "issues", "stages", F.struct("failed_accessions").alias("holdings_ingestion")))
    o = A.table(spark, sf, "orders").withColumn("created_at", F.col("o_orderdate").cast("timestamp")).join(lines, key == F.col("l_orderkey"), "left")
    hours = lambda h: F.col("created_at") + F.make_dt_interval(hours=F.lit(h))
    return o.select(
        key.alias("job"), F.element_at(F.array(*map(F.lit, ("quarterly_pipeline", "enrich_metadata", "ingest_quarter", "ingest_accession"))), (key % 4 + 1).cast("int")).alias("job_type"), F.when(key % 2 == 0, "cron").otherwise("hand").alias("trigger"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "partial_success").otherwise("succeeded").alias("status"), "created_at", F.when(key % 5 > 0, hours(1)).alias("started_at"), F.when(key % 3 == 0, hours(1)).alias("heartbeat_at"),
        F.when(key % 7 > 0, hours(24)).alias("finished_at"), F.when(key % 11 == 0, "boom").when(key % 11 == 1, "").alias("error_message"),
        F.when(key % 6 > 0, F.concat(text(F.year("created_at")), F.lit("-Q"), text(F.quarter("created_at")))).alias("quarter"), F.when(key % 13 == 0, "{broken").otherwise(summary).alias("summary"),
    )


@query(f"""with {_JOBS},
e as (select job, created_at as moment, 1 as place, 0 as n, 0 as p, 'job_created' as kind, job_type || ' queued from ' || trigger as message, 'info' as severity, null as accession from j union all
  select job, started_at, 2, 0, 0, 'job_started', job_type || ' started', 'info', null from j where started_at is not null union all
  select job, heartbeat_at, 3, 0, 0, 'job_heartbeat', 'Worker heartbeat recorded', 'info', null from j where heartbeat_at is not null union all
  select job, finished_at, 4, n, p, 'accession_failed', coalesce(nullif(error, ''), 'Accession failed'), 'error', accession_no from lines join j using (job) where flag = 'R' union all
  select job, finished_at, 5, n, p, 'quality_issue', coalesce(detail, check_, 'Quality issue'), coalesce(lines.severity, 'warning'), null from lines join j using (job) where flag = 'N' union all
  select job, finished_at, 6, 0, 0, 'job_error', error_message, 'error', null from j where error_message <> '' union all
  select job, finished_at, 7, 0, 0, 'job_finished', job_type || ' finished with status ' || status, case status when 'failed' then 'error' when 'partial_success' then 'warning' else 'info' end, null from j where finished_at is not null)
select job, row_number() over (partition by job order by moment nulls first, place, n, p) as seq, kind, strftime(moment, '%Y-%m-%d %H:%M:%S') as happened, message, severity, accession from e""")
def n14_job_events(spark, sf):
    e = JOB.events(job_runs(spark, sf))
    return e.select("job", F.col("seq").cast("long").alias("seq"), "kind", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("happened"), "message", "severity", "accession")


@query(f"""with {_JOBS},
a as (select job, accession_no, min((n, p)) as line from lines where flag = 'R' and accession_no is not null group by all),
t as (select job, 1 as place, (n, p) as line, stage as target, quarter, null as accession, 'Retry ' || case stage when 'fetch_quarter_index' then 'index fetch' when 'ingest_holdings' then 'holdings' else stage end || ' for ' || coalesce(quarter, 'unknown') as label
    from lines join j using (job) where job_type = 'quarterly_pipeline' and stage is not null and stage_status <> 'succeeded' union all
  select job, 2, (0, 0), job_type, quarter, null, 'Retry Enrichment for ' || quarter from j where job_type like 'enrich%' and quarter is not null and status <> 'succeeded' union all
  select job, 3, a.line, 'ingest_accession', null, accession_no, 'Retry accession ' || accession_no from a join j using (job) where not (job_type like 'enrich%' and quarter is not null and status <> 'succeeded'))
select job, row_number() over (partition by job order by place, line) as seq, target, quarter, accession, label from t""")
def n15_retry_targets(spark, sf):
    return JOB.retry_targets(job_runs(spark, sf)).withColumn("seq", F.col("seq").cast("long"))


@query("""with c as (select c_custkey as site, count(*) filter (o_orderstatus = 'P' and o_orderpriority[1] = '1') as b, count(*) filter (o_orderstatus = 'P' and o_orderpriority[1] = '2') as w,
  count(*) filter (o_orderstatus = 'O' and o_orderpriority[1] = '1' and o_orderkey % 4 = 0) as p0, count(*) filter (o_orderstatus = 'O' and o_orderpriority[1] = '2' and o_orderkey % 4 = 0) as p1, count(*) filter (o_orderstatus = 'O' and o_orderkey % 4 = 0) as tasks,
  c_custkey % 3 > 0 as available, c_custkey % 4 = 0 as unknown from customer left join orders on o_custkey = c_custkey group by c_custkey),
r as (select *, concat_ws(', ', case when b > 0 then b || ' blocked setup item' || case when b = 1 then '' else 's' end end, case when w > 0 then w || ' warning setup item' || case when w = 1 then '' else 's' end end,
  case when p0 > 0 then p0 || ' P0 task' || case when p0 = 1 then '' else 's' end end, case when p1 > 0 then p1 || ' P1 task' || case when p1 = 1 then '' else 's' end end, case when unknown then 'worker heartbeat unavailable' when not available then 'no active worker heartbeat' end) as reasons,
  case when b + w + tasks = 0 and unknown then 'unknown' when b > 0 or p0 > 0 or not (available or unknown) then 'blocked' when w > 0 or tasks > 0 then 'attention' else 'healthy' end as level from c)
select site, level, case level when 'unknown' then 'Worker heartbeat unavailable; refresh or inspect the workers API.' when 'healthy' then 'No operational blockers detected.' else case when reasons <> '' then reasons else tasks || ' task' || case when tasks = 1 then '' else 's' end || ' pending' end end as summary from r""")
def m21_operations_health(spark, sf):
    c, o = A.table(spark, sf, "customer"), A.table(spark, sf, "orders")
    status, first, some = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("o_orderkey") % 4 == 0
    counts = {"b": (status == "P") & (first == "1"), "w": (status == "P") & (first == "2"), "p0": (status == "O") & (first == "1") & some, "p1": (status == "O") & (first == "2") & some, "tasks": (status == "O") & some}
    per = o.groupBy("o_custkey").agg(*[F.count_if(v).alias(k) for k, v in counts.items()])
    sites = c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, list(counts))
    h = JOB.health(*[F.col(k) for k in counts], F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 4 == 0)
    return sites.select(F.col("c_custkey").alias("site"), h.alias("h")).select("site", "h.*")


@query("""with f as (select o_orderkey as fact_id, o_custkey as c, case when o_orderkey % 5 = 0 then 'snapshot' when coalesce(bool_or(l_shipdate >= date '1997-01-01'), false) then 'estimate' else 'actual' end as nature from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey)
select fact_id, fact_id % 4 <> 2 as changed, case fact_id % 4 when 0 then '{"fact_nature":"' || nature || '"}' when 1 then '{"total":' || c || ',"fact_nature":"' || nature || '"}' when 2 then '{"fact_nature":"actual","total":' || c || '}'
  else '{"x":[1,{"y":' || c || '}],"fact_nature":"' || nature || '"}' end as value_json from f""")
def n09_marked_json(spark, sf):
    o, k, c = A.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey").cast("string")
    inputs = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.to_date("l_shipdate") >= F.lit("1997-01-01").cast("date")).alias("estimate"))
    old = F.when(k % 4 == 1, F.concat(F.lit('{"total":'), c, F.lit("}"))).when(k % 4 == 2, F.concat(F.lit('{"fact_nature":"actual","total":'), c, F.lit("}"))).when(k % 4 == 3, F.concat(F.lit('{"fact_nature":null,"x":[1,{"y":'), c, F.lit("}]}")))
    nature = F.when(k % 5 == 0, "snapshot").when(F.col("estimate"), "estimate").otherwise("actual")
    facts = o.join(inputs, k == F.col("l_orderkey"), "left").select(k.alias("fact_id"), old.alias("value_json"), nature.alias("nature"))
    return DOC.marked(facts, "value_json", "fact_nature", F.col("nature")).select("fact_id", "changed", "value_json")


@query("""with e as (select c_nationkey as n, c_custkey as k, lower(c_mktsegment) || ' ' || (c_custkey % 20) as name, 'C' || (c_custkey % 50) as ticker, c_mktsegment || ' ' || (c_custkey % 20) || ', Inc.' as title from customer where c_custkey % 9 > 0)
select name, arg_min(ticker, (n, k)) as ticker, arg_min(title, (n, k)) as title from e group by name""")
def s10_ticker_map(spark, sf):
    k = F.col("c_custkey")
    number = lambda m: (k % m).cast("string")
    company = F.struct(F.when(k % 9 > 0, F.concat(F.lit(" c"), number(50))).otherwise(" ").alias("ticker"), F.concat("c_mktsegment", F.lit(" "), number(20), F.lit(", Inc. ")).alias("title"))
    each = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.lpad(k.cast("string"), 12, "0").alias("key"), company.alias("value")))))
    lists = A.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.to_json(each).alias("j"))
    return SRC.ticker_map(lists, "c_nationkey", "j")


@query("""with g as (select l_suppkey as manager, p_brand as stock, count(*) as rows, count(distinct l_orderkey) as orders from lineitem join part on p_partkey = l_partkey group by all),
r as (select *, row_number() over (partition by stock order by rows desc, manager) as rn, count(*) over (partition by stock) as total from g)
select stock, '{"stock":"' || stock || '","total":' || any_value(total) || ',"items":[' || string_agg('{"manager":' || manager || ',"rows":' || rows || ',"orders":' || orders || '}', ',' order by rn) || ']}' as payload from r where rn <= 50 group by stock""")
def s20_holders_payload(spark, sf):
    brands = A.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("stock"))
    rows = A.table(spark, sf, "lineitem").join(brands, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_suppkey").alias("manager"), "stock").agg(F.count("*").alias("rows"), F.count_distinct("l_orderkey").alias("orders"))
    return PG.payload(rows, "stock", [F.desc("rows"), F.asc("manager")], ["manager", "rows", "orders"])


_STATE = """s as (select c_custkey as site, c_custkey % 3 > 0 as scheduler, count(o_orderkey) as managers, count(*) filter (o_orderstatus = 'F') as confirmed, count(*) filter (o_orderpriority[1] = '1') as candidates, c_custkey % 4 > 0 as index_fetched,
  count(*) filter (o_orderkey % 3 = 0) as filings, count(*) filter (o_orderkey % 8 = 1) as failed_filings, count(*) filter (o_orderkey % 4 = 0) as holdings, case when count(o_orderkey) > 0 then count(*) filter (o_orderpriority[1] <> '5') / count(o_orderkey) end as linked,
  ['no_amendments', 'amendments_applied', 'amendments_pending', 'amendment_failed', null][1 + (c_custkey % 5)::int] as amendments, ['passed', 'warning', 'failed'][1 + (c_custkey % 7 % 3)::int] as quality, count(distinct year(o_orderdate)) + count(*) filter (o_orderkey % 5 = 0) as depth
  from customer left join orders on o_custkey = c_custkey group by c_custkey)"""


def site_states(spark, sf):
    """Customers as sites with the state of their setup, counted from their orders."""
    o, k, first, site = A.table(spark, sf, "orders"), F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1), F.col("c_custkey")
    counts = [F.count("*").alias("managers"), F.count_if(F.col("o_orderstatus") == "F").alias("confirmed"), F.count_if(first == "1").alias("candidates"), F.count_if(k % 3 == 0).alias("filings"), F.count_if(k % 8 == 1).alias("failed_filings"), F.count_if(k % 4 == 0).alias("holdings")]
    per = o.groupBy("o_custkey").agg(*counts, (F.count_if(first != "5") / F.count("*")).alias("linked"), (F.count_distinct(F.year("o_orderdate")) + F.count_if(k % 5 == 0)).alias("depth"))
    rows = A.table(spark, sf, "customer").join(per, site == F.col("o_custkey"), "left").fillna(0, ["managers", "confirmed", "candidates", "filings", "failed_filings", "holdings", "depth"])
    amendments = F.element_at(F.array(*map(F.lit, ("no_amendments", "amendments_applied", "amendments_pending", "amendment_failed", None))), (site % 5 + 1).cast("int"))
    quality = F.element_at(F.array(*map(F.lit, ("passed", "warning", "failed"))), (site % 7 % 3 + 1).cast("int"))
    return rows.withColumns({"site": site, "scheduler": site % 3 > 0, "index_fetched": site % 4 > 0, "amendments": amendments, "quality": quality})


@query(f"""with {_STATE},
i as (select site, 'SCHEDULER_CONFIGURED' as code, scheduler as done, false as part from s union all select site, 'MANAGER_WHITELIST_SEEDED', managers > 0, false from s union all select site, 'MANAGER_CIKS_CONFIRMED', confirmed > 0, false from s union all
  select site, 'QUARTER_INDEX_FETCHED', index_fetched, false from s union all select site, 'FILINGS_AVAILABLE', filings > 0, false from s union all select site, 'HOLDINGS_INGESTED', holdings > 0, false from s union all
  select site, 'CUSIP_ENRICHED', linked >= 0.8, linked is not null from s union all select site, 'QUALITY_CHECKED', quality = 'passed' and amendments in ('no_amendments', 'amendments_applied'), false from s union all select site, 'HISTORICAL_DEPTH_TARGET', depth >= 4, depth > 0 from s)
select site, code, case when done then 'complete' when part then 'warning' else 'blocked' end as status from i""")
def m20_setup_checklist(spark, sf):
    return JOB.checklist(site_states(spark, sf), "site").select("site", "code", "status")


@query(f"""with {_STATE},
t as (select site, 'P0' as priority, 1 as place, 'EDGAR_SCHEDULER_DISABLED' as code from s where not scheduler union all select site, 'P0', 2, 'NO_CONFIRMED_MANAGER_CIK_WHITELIST' from s where confirmed = 0 union all select site, 'P1', 3, 'CIK_CANDIDATES_NEED_REVIEW' from s where candidates > 0 union all
  select site, 'P1', 4, 'QUARTER_INDEX_FETCHED_NO_FILINGS' from s where index_fetched and filings = 0 union all select site, 'P1', 5, 'FILING_PARSE_FAILURES' from s where failed_filings > 0 union all select site, 'P1', 6, 'AMENDMENT_PENDING_OR_FAILED' from s where amendments in ('amendments_pending', 'amendment_failed') union all
  select site, 'P2', 7, 'LOW_STOCK_LINK_COVERAGE' from s where linked < 0.8 union all select site, 'P1', 8, 'QUALITY_ERRORS' from s where quality = 'failed' union all select site, 'P2', 9, 'QUALITY_WARNINGS' from s where quality = 'warning' union all
  select site, 'P2', 10, 'HISTORICAL_COVERAGE_BELOW_TARGET' from s where confirmed > 0 and depth < 4 union all select site, 'P3', 11, 'EXTENDED_BACKFILL_RECOMMENDED' from s where confirmed > 0 and depth < 8)
select site, row_number() over (partition by site order by priority, place) as seq, priority, code from t""")
def m20_tasks(spark, sf):
    return JOB.tasks(site_states(spark, sf), "site").select("site", F.col("seq").cast("long").alias("seq"), "priority", "code")
