"""Job runs read back: events in time order, what to try again, the health of operations.

A job's summary is a JSON text; it is read as a variant, so a broken text, a missing list and
list items that aren't objects give nothing, and other items of the same list still count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: stages of a quarter's run and what trying them again is called; states that call for it
STAGE_LABELS = {"fetch_quarter_index": "index fetch", "ingest_holdings": "holdings", "enrich_metadata": "enrichment", "quality_check": "quality check"}
STAGE_AGAIN = ("failed", "partial_success", "conflict")
JOB_AGAIN = ("failed", "partial_success")
ENRICHING = ("enrich_metadata", "enrich_cusip")


def _filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def _text(item: Column, key: str) -> Column:
    return _filled(F.try_variant_get(item, f"$.{key}", "string"))


def _objects(summary: Column, path: str) -> Column:
    """The objects of a list in the summary."""
    found = F.coalesce(F.try_variant_get(summary, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.filter(found, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _event(kind: str, at: Column, message: Column, severity: Column, accession: Column | None = None) -> Column:
    none = F.lit(None).cast("string") if accession is None else accession
    return F.struct(F.lit(kind).alias("kind"), at.alias("at"), message.alias("message"), severity.alias("severity"), none.alias("accession"))


def events(jobs: DataFrame) -> DataFrame:
    """job, seq (from 1), kind, at, message, severity, accession of every event of a job.

    jobs: job, job_type, trigger, status, created_at, started_at, heartbeat_at, finished_at, error_message,
    summary.  Events without a time come first; equal times keep the order created, started, heartbeat,
    failed accessions, issues, error, finished.  Further columns are ignored; a job without any
    time, failure or error has no events.
    """
    summary, info, error = F.try_parse_json(F.col("summary")), F.lit("info"), F.lit("error")
    created, started, beat, done = (F.col(c) for c in ("created_at", "started_at", "heartbeat_at", "finished_at"))
    said = _filled(F.col("error_message"))
    ending = F.when(F.col("status") == "failed", "error").when(F.col("status") == "partial_success", "warning").otherwise("info")
    single = [
        (created, _event("job_created", created, F.concat("job_type", F.lit(" queued from "), "trigger"), info)),
        (started, _event("job_started", started, F.concat("job_type", F.lit(" started")), info)),
        (beat, _event("job_heartbeat", beat, F.lit("Worker heartbeat recorded"), info)),
        (said, _event("job_error", done, said, error)),
        (done, _event("job_finished", done, F.concat("job_type", F.lit(" finished with status "), "status"), ending)),
    ]
    one = [F.when(present.isNotNull(), event) for present, event in single]
    failures = F.transform(_objects(summary, "$.failed_accessions"), lambda x: _event("accession_failed", done, F.coalesce(_text(x, "error"), F.lit("Accession failed")), error, _text(x, "accession_no")))
    issues = F.transform(_objects(summary, "$.issues"), lambda x: _event("quality_issue", done, F.coalesce(_text(x, "detail"), _text(x, "check"), F.lit("Quality issue")), F.coalesce(_text(x, "severity"), F.lit("warning")), _text(x, "accession_no")))
    found = F.array_compact(F.concat(F.array(*one[:3]), failures, issues, F.array(*one[3:])))
    ordered = F.sort_array(F.transform(found, lambda e, i: F.struct(e["at"].alias("at"), i.alias("place"), e.alias("event"))))
    return jobs.select("job", F.posexplode(ordered).alias("seq", "e")).select("job", (F.col("seq") + 1).alias("seq"), "e.event.*")


def retry_targets(jobs: DataFrame) -> DataFrame:
    """job, seq (from 1), target, quarter, accession, label: what of a job can be tried again.

    jobs: job, job_type, status, quarter, summary.  A quarter's run gives its stages that failed and the
    accessions that its holdings stage failed on; an enrichment of a quarter that failed gives itself; any
    other job the accessions of its summary.  An accession comes once a job, where it stands first.
    """
    summary, quarter, none = F.try_parse_json(F.col("summary")), _filled(F.col("quarter")), F.lit(None).cast("string")

    def target(kind: Column, quarter: Column, accession: Column, label: Column) -> Column:
        return F.struct(kind.alias("target"), quarter.alias("quarter"), accession.alias("accession"), label.alias("label"))

    def accessions(path: str) -> Column:
        names = F.array_distinct(F.array_compact(F.transform(_objects(summary, path), lambda x: _text(x, "accession_no"))))
        return F.transform(names, lambda a: target(F.lit("ingest_accession"), none, a, F.concat(F.lit("Retry accession "), a)))

    failed = F.filter(_objects(summary, "$.stages"), lambda x: _text(x, "status").isin(*STAGE_AGAIN) & _text(x, "job_type").isNotNull())
    names = F.create_map(*[F.lit(v) for pair in STAGE_LABELS.items() for v in pair])
    stages = F.transform(failed, lambda x: target(_text(x, "job_type"), F.col("quarter"), none, F.concat(F.lit("Retry "), F.coalesce(names[_text(x, "job_type")], _text(x, "job_type")), F.lit(" for "), F.coalesce(quarter, F.lit("unknown")))))
    itself = F.array(target(F.col("job_type"), F.col("quarter"), none, F.concat(F.lit("Retry Enrichment for "), quarter)))
    enriching = F.col("job_type").isin(*ENRICHING) & quarter.isNotNull() & F.col("status").isin(*JOB_AGAIN)
    found = F.when(F.col("job_type") == "quarterly_pipeline", F.concat(stages, accessions("$.holdings_ingestion.failed_accessions"))).when(enriching, itself).otherwise(accessions("$.failed_accessions"))
    return jobs.select("job", F.posexplode(found).alias("seq", "t")).select("job", (F.col("seq") + 1).alias("seq"), "t.*")


def _counted(n: Column, one: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s")))


def health(blocked: Column, warnings: Column, p0: Column, p1: Column, tasks: Column, available: Column, unknown: Column) -> Column:
    """A struct of level (unknown, blocked, attention, healthy) and summary, from counts of setup items and
    tasks, whether a worker is available, and whether that can't be told."""
    said = [_counted(blocked, "blocked setup item"), _counted(warnings, "warning setup item"), _counted(p0, "P0 task"), _counted(p1, "P1 task")]
    workers = F.when(unknown, "worker heartbeat unavailable").when(~available, "no active worker heartbeat")
    reasons = F.concat_ws(", ", *said, workers)
    nothing = (blocked == 0) & (warnings == 0) & (p0 == 0) & (p1 == 0) & (tasks == 0)
    level = F.when(nothing & unknown, "unknown").when((blocked > 0) | (p0 > 0) | (~available & ~unknown), "blocked").when((warnings > 0) | (p1 > 0) | (tasks > 0), "attention").otherwise("healthy")
    pending = F.coalesce(_filled(reasons), F.concat(_counted(tasks, "task"), F.lit(" pending")))
    summary = F.when(level == "unknown", "Worker heartbeat unavailable; refresh or inspect the workers API.").when(level == "healthy", "No operational blockers detected.").otherwise(pending)
    return F.struct(level.alias("level"), summary.alias("summary"))


#: the share of linked holdings and the quarters in a row that count as ready
READY_LINKED, READY_DEPTH, LONG_DEPTH = 0.8, 4, 8
_STATE = ["scheduler", "managers", "confirmed", "candidates", "index_fetched", "filings", "failed_filings", "holdings", "linked", "amendments", "quality", "depth"]


def _rules(state: DataFrame, ident: str, rules: list[tuple[Column, ...]], names: list[str]) -> DataFrame:
    """A row a rule and row of state whose first column isn't null, in the rules' order."""
    items = F.array(*[F.when(r[0].isNotNull(), F.struct(F.lit(k).alias("place"), *[c.alias(n) for n, c in zip(names, r)])) for k, r in enumerate(rules)])
    return state.select(ident, F.explode(F.array_compact(items)).alias("x")).select(ident, "x.*")


def checklist(state: DataFrame, ident: str) -> DataFrame:
    """ident, place (from 0), status (complete, warning, blocked), code, action of the nine steps of a setup.

    state: ident, scheduler (boolean), managers, confirmed, index_fetched (boolean), filings, holdings, linked (share, null
    if none is known), amendments, quality, depth.  A null count or flag is a step not done.
    """
    c = {name: F.col(name) for name in _STATE if name in state.columns}
    settled = c["amendments"].isin("no_amendments", "amendments_applied")
    # fixed values: codes and actions of the steps
    steps = [
        ("SCHEDULER_CONFIGURED", c["scheduler"], None, "Enable EDGAR_SCHEDULER_ENABLED and redeploy the API service"),
        ("MANAGER_WHITELIST_SEEDED", c["managers"] > 0, None, "Bootstrap whitelist"),
        ("MANAGER_CIKS_CONFIRMED", c["confirmed"] > 0, None, "Bootstrap whitelist, match CIK, review candidates"),
        ("QUARTER_INDEX_FETCHED", c["index_fetched"], None, "Fetch quarter index"),
        ("FILINGS_AVAILABLE", c["filings"] > 0, None, "Fetch quarter index or inspect whitelist coverage"),
        ("HOLDINGS_INGESTED", c["holdings"] > 0, None, "Ingest holdings"),
        ("CUSIP_ENRICHED", c["linked"] >= READY_LINKED, c["linked"].isNotNull(), "Run CUSIP enrichment and bootstrap stocks"),
        ("QUALITY_CHECKED", (c["quality"] == "passed") & settled, None, "Run quality check and reprocess pending or failed amendments"),
        ("HISTORICAL_DEPTH_TARGET", c["depth"] >= READY_DEPTH, c["depth"] > 0, "Run historical backfill"),
    ]
    rules = [(F.when(done, "complete").when(F.lit(False) if part is None else part, "warning").otherwise("blocked"), F.lit(code), F.lit(action)) for code, done, part, action in steps]
    return _rules(state, ident, rules, ["status", "code", "action"])


def tasks(state: DataFrame, ident: str) -> DataFrame:
    """ident, seq (from 1), priority, code, action: what is to be done by priority, then in the order below.

    state: as for ``checklist``, with candidates and failed_filings.  Tasks that single jobs or workers call for aren't among them.
    """
    c = {name: F.col(name) for name in _STATE}
    some = c["confirmed"] > 0
    # fixed values: priorities, codes and actions
    wanted = [
        ("P0", "EDGAR_SCHEDULER_DISABLED", ~F.coalesce(c["scheduler"], F.lit(False)), "Enable EDGAR_SCHEDULER_ENABLED and redeploy the API service"),
        ("P0", "NO_CONFIRMED_MANAGER_CIK_WHITELIST", ~F.coalesce(some, F.lit(False)), "Bootstrap whitelist, match CIK, review candidates"),
        ("P1", "CIK_CANDIDATES_NEED_REVIEW", c["candidates"] > 0, "Confirm or reject candidate"),
        ("P1", "QUARTER_INDEX_FETCHED_NO_FILINGS", c["index_fetched"] & (c["filings"] == 0), "Check whitelist and form parser"),
        ("P1", "FILING_PARSE_FAILURES", c["failed_filings"] > 0, "Retry failed filings or inspect EDGAR document"),
        ("P1", "AMENDMENT_PENDING_OR_FAILED", c["amendments"].isin("amendments_pending", "amendment_failed"), "Run Reprocess amendment for each pending or failed 13F/A accession"),
        ("P2", "LOW_STOCK_LINK_COVERAGE", c["linked"] < READY_LINKED, "Run CUSIP enrichment, review unmatched CUSIPs"),
        ("P1", "QUALITY_ERRORS", c["quality"] == "failed", "Inspect latest quality report and rerun quality check after fixes"),
        ("P2", "QUALITY_WARNINGS", c["quality"] == "warning", "Review quality warnings and accept or fix"),
        ("P2", "HISTORICAL_COVERAGE_BELOW_TARGET", some & (c["depth"] < READY_DEPTH), "Run historical backfill and show feature-depth warning"),
        ("P3", "EXTENDED_BACKFILL_RECOMMENDED", some & (c["depth"] < LONG_DEPTH), "Run historical backfill when rate-limit budget allows"),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(p).alias("priority"), F.lit(k).alias("place"), F.lit(code).alias("code"), F.lit(action).alias("action"))) for k, (p, code, when, action) in enumerate(wanted)]))
    rows = state.select(ident, F.posexplode(F.sort_array(found)).alias("seq", "x"))
    return rows.select(ident, (F.col("seq") + 1).alias("seq"), "x.priority", "x.code", "x.action")
