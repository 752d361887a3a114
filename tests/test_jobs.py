"""Job runs, marked JSON, company lists and payloads on small fixtures: broken texts, nulls, repeats, clashing columns, empty tables."""

import datetime
import json

from pyspark.sql import functions as F

from tallyspark.operators import documents as DOC
from tallyspark.operators import jobs as JOB
from tallyspark.operators import pages as PG
from tallyspark.sources import filings as SRC

T = datetime.datetime
SCHEMA = "job long, job_type string, trigger string, status string, created_at timestamp, started_at timestamp, heartbeat_at timestamp, finished_at timestamp, error_message string, quarter string, summary string, seq string"


def runs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_events(spark):
    day = T(2024, 1, 1)
    summary = json.dumps({"failed_accessions": [3, None, "x", {"accession_no": "a1", "error": ""}, {"error": "late"}], "issues": [{"check": "sum"}, {"detail": "d", "severity": "error"}, {}]})
    rows = [
        (1, "t", "cron", "partial_success", day, day, None, None, "boom", None, summary),
        (2, "t", "cron", "failed", None, None, None, day, "", None, "{broken"),
        (3, "t", "cron", "queued", None, None, None, None, None, None, '{"issues": 5, "failed_accessions": null}'),
    ]
    got = [(r.job, r.seq, r.kind, r.message, r.severity, r.accession) for r in JOB.events(runs(spark, rows)).orderBy("job", "seq").collect()]
    assert got == [
        (1, 1, "accession_failed", "Accession failed", "error", "a1"), (1, 2, "accession_failed", "late", "error", None), (1, 3, "quality_issue", "sum", "warning", None), (1, 4, "quality_issue", "d", "error", None),
        (1, 5, "quality_issue", "Quality issue", "warning", None), (1, 6, "job_error", "boom", "error", None), (1, 7, "job_created", "t queued from cron", "info", None), (1, 8, "job_started", "t started", "info", None),
        (2, 1, "job_finished", "t finished with status failed", "error", None),
    ]
    assert JOB.events(runs(spark, rows[:0])).count() == 0


def test_retry_targets(spark):
    failures = [{"accession_no": "b"}, {"accession_no": "a"}, 7, {"accession_no": "b"}, {"accession_no": ""}, {}]
    stages = [{"job_type": "quality_check", "status": "conflict"}, {"job_type": "own", "status": "failed"}, {"status": "failed"}, {"job_type": "ingest_holdings", "status": "succeeded"}, 1]
    rows = [
        (1, "quarterly_pipeline", None, "failed", None, None, None, None, None, None, json.dumps({"stages": stages, "holdings_ingestion": {"failed_accessions": failures}})),
        (2, "enrich_cusip", None, "failed", None, None, None, None, None, "2024-Q1", json.dumps({"failed_accessions": failures})),
        (3, "enrich_cusip", None, "succeeded", None, None, None, None, None, "2024-Q1", json.dumps({"failed_accessions": failures})),
        (4, "other", None, "failed", None, None, None, None, None, "2024-Q1", None),
    ]
    got = [(r.job, r.seq, r.target, r.label) for r in JOB.retry_targets(runs(spark, rows)).orderBy("job", "seq").collect()]
    one = "ingest_accession"
    assert got == [
        (1, 1, "quality_check", "Retry quality check for unknown"), (1, 2, "own", "Retry own for unknown"), (1, 3, one, "Retry accession b"), (1, 4, one, "Retry accession a"),
        (2, 1, "enrich_cusip", "Retry Enrichment for 2024-Q1"), (3, 1, one, "Retry accession b"), (3, 2, one, "Retry accession a"),
    ]
    assert JOB.retry_targets(runs(spark, rows[:0])).count() == 0


def test_health(spark):
    cases = {(0, 0, 0, 0, 0, True, False): "healthy", (0, 0, 0, 0, 0, False, True): "unknown", (0, 0, 0, 0, 0, False, False): "blocked", (0, 0, 0, 0, 2, True, False): "attention", (0, 1, 0, 0, 0, False, True): "attention", (2, 0, 0, 1, 1, True, False): "blocked"}
    df = spark.createDataFrame(list(cases), "b int, w int, p0 int, p1 int, t int, a boolean, u boolean")
    got = df.select("*", JOB.health(*map(F.col, df.columns)).alias("h")).collect()
    assert {tuple(r)[:7]: r.h.level for r in got} == cases
    assert {r.h.summary for r in got} >= {"2 tasks pending", "1 warning setup item, worker heartbeat unavailable", "2 blocked setup items, 1 P1 task", "no active worker heartbeat"}


def test_marked(spark):
    texts = [None, "", "{broken", "[1]", "{}", '{"k":"v"}', '{"k":null,"a":{"b":[1,null]}}', '{"a.b":1.50,"k2":true}', '{"a":null}']
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, j string, key string")
    got = [(r.changed, r.j) for r in DOC.marked(df, "j", "k", F.lit("n")).orderBy("i").collect()]
    alone = (True, '{"k":"n"}')
    assert got[:6] == [alone, alone, alone, alone, alone, (False, '{"k":"v"}')]
    assert [(c, json.loads(j)) for c, j in got[6:]] == [(True, {"a": {"b": [1, None]}, "k": "n"}), (True, {"a.b": 1.5, "k2": True, "k": "n"}), (True, {"a": None, "k": "n"})]
    again = DOC.marked(DOC.marked(df, "j", "k", F.lit("n")).drop("changed"), "j", "k", F.lit("other"))
    assert again.where("changed").count() == 0
    assert DOC.marked(df, "j", "k", F.lit(None).cast("string")).where("changed").count() == 0


def test_ticker_map(spark):
    docs = [(2, '{"0":{"ticker":"late","title":"Acme Inc"}}'), (1, '{"0":{"ticker":" ","title":"Acme Corp"},"1":{"ticker":"b","title":"ACME, Inc."},"2":{"ticker":"c","title":"Acme"},"3":{"title":"No"},"4":{"ticker":"d","title":"The Co"}}'), (3, "broken"), (4, None)]
    df = spark.createDataFrame(docs, "id int, j string")
    assert [tuple(r) for r in SRC.ticker_map(df, "id", "j").collect()] == [("acme", "B", "ACME, Inc.")]
    assert SRC.ticker_map(df.limit(0), "id", "j").count() == 0


def test_payload(spark):
    df = spark.createDataFrame([("g", i, None if i % 2 else i, "c") for i in range(5)] + [(None, 1, 1, "c")], "by string, i int, v int, total string")
    got = PG.payload(df, "by", [F.desc("i")], ["i", "v"], 3).collect()
    assert [json.loads(r.payload) for r in got] == [{"by": "g", "total": 5, "items": [{"i": 4, "v": 4}, {"i": 3, "v": None}, {"i": 2, "v": 2}]}]
    assert PG.payload(df.limit(0), "by", [F.desc("i")], ["i"]).count() == 0


def test_setup(spark):
    schema = "id int, scheduler boolean, managers long, confirmed long, candidates long, index_fetched boolean, filings long, failed_filings long, holdings long, linked double, amendments string, quality string, depth long, code string"
    rows = [(1, True, 2, 2, 0, True, 3, 0, 9, 0.8, "no_amendments", "passed", 8, "x"), (2, *[None] * 12, "x"), (3, False, 1, 1, 1, True, 0, 2, 0, 0.5, "amendment_failed", "failed", 3, "x")]
    df = spark.createDataFrame(rows, schema)
    status = {}
    for r in JOB.checklist(df, "id").orderBy("id", "place").collect():
        status.setdefault(r.id, []).append(r.status[0])
    assert {k: "".join(v) for k, v in status.items()} == {1: "c" * 9, 2: "b" * 9, 3: "bcccbbwbw"}
    todo = [(r.id, r.priority) for r in JOB.tasks(df, "id").orderBy("id", "seq").collect()]
    assert todo == [(2, "P0"), (2, "P0"), *[(3, p) for p in ("P0", "P1", "P1", "P1", "P1", "P1", "P2", "P2", "P3")]]
    assert JOB.tasks(df.limit(0), "id").count() == JOB.checklist(df.limit(0), "id").count() == 0
