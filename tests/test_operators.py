"""Small fixtures with known answers: nulls, ties, empty inputs, parsers and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import documents as DOC
from tallyspark.operators import filings as FI
from tallyspark.operators import latest as L
from tallyspark.operators import match as MA
from tallyspark.operators import metrics as M
from tallyspark.operators import screen as SC
from tallyspark.sources import filings as SRC
from tallyspark.streaming import requests as RQ

D = datetime.date


def facts(spark, rows):
    return spark.createDataFrame([(1, D(y, 12, 31), k, None if v is None else float(v), i) for i, (y, k, v) in enumerate(rows)], "stock long, period_end date, metric_key string, value double, fact_id long")


def test_owner_earnings(spark):
    table = {2019: (1, None, None, None), 2020: (2, 1, 5, 10), 2021: (3, 1, None, 10), 2022: (None, 1, 5, 10), 2023: (4, None, 0, None), 2024: (5, 2, 10, 20)}
    keys = ["per_share.eps", "per_share.capital_spending", "is.depreciation", "equity.shares_outstanding"]
    e = M.owner_earnings(facts(spark, [(y, k, v) for y, vs in table.items() for k, v in zip(keys, vs) if v is not None]))
    assert {r.period_end.year: r.value for r in e.collect()} == {2019: 1.0, 2020: 1.5, 2021: 2.0, 2022: -0.5, 2023: 4.0, 2024: 3.5}
    assert M.normalized(e).first().value == 2.0


def test_score(spark):
    both = {"returns.roa": (0.08, 0.10), "leverage.long_term_debt_to_assets": (0.3, 0.2), "liquidity.current_ratio": (1.5, 2), "equity.shares_outstanding": (10, 9), "is.gross_margin": (0.4, 0.45), "efficiency.asset_turnover": (1.1, 1.2)}
    rows = [(y, k, v[i]) for k, v in both.items() for i, y in enumerate((2023, 2024))] + [(2024, "is.operating_cash_flow", 150), (2024, "is.net_income", 100)]
    t = {r.period_end.year: r for r in M.score_totals(M.score_components(facts(spark, rows))).collect()}
    assert (t[2024].total, t[2024].status, t[2024].variant) == (9, "calculated", "standard")
    assert t[2023].total is None and t[2023].partial_score == 1 and t[2023].available == 1


def test_screen_and_formula(spark):
    f = spark.createDataFrame([(1, "pe", 10.0), (1, "yld", 0.03), (2, "pe", 30.0), (2, "yld", 0.01)], "stock long, metric_key string, value double")
    stocks = f.select("stock").distinct()
    rule = lambda *cs: {"type": "AND", "conditions": [dict(zip(("metric", "operator", "value"), c)) for c in cs]}
    ids = lambda r: {x.stock for x in SC.matches(f, r, stocks).collect()}
    assert ids(rule(("pe", "<", 20))) == {1} and ids(rule(("pe", ">", 25))) == {2} and ids(rule(("pe", "<", 20), ("yld", "<", 0.02))) == set()
    assert ids({"type": "OR", "conditions": []}) == {1, 2} and ids(rule(("pe", "~", 1))) == {1, 2}
    one = spark.range(1).select(SC.formula("sales - expenses * 1.1", {"sales": F.lit(100.0), "expenses": F.lit(80.0)}).alias("x")).first().x
    assert abs(one - 12) < 1e-9
    with pytest.raises(ValueError):
        SC.dependencies("abs(x)")
    with pytest.raises(ValueError):
        SC.formula("x > 1", {"x": F.lit(1)})
    with pytest.raises(KeyError):
        SC.formula("y", {})


def test_slot_nulls_and_empty(spark):
    rows = [(1, 5, None, 7), (2, 5, D(2024, 1, 1), 3), (3, 5, D(2024, 1, 1), 4), (4, 6, None, None)]
    f = spark.createDataFrame(rows, "fact long, slot long, day date, doc long")
    got = {r.fact: r.is_current for r in L.slot_winner(f, ["slot"], "day", "doc", "fact").collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}
    assert L.slot_winner(f.limit(0), ["slot"], "day", "doc", "fact").count() == 0


def test_form_index(spark):
    lines = ["Form Type   Company Name   CIK   Date Filed  File Name", "-" * 40, "13F-HR      ALPHA FUND LP            1234       2025-02-14  edgar/data/1234/0001234567-25-000001.txt", "13F-HR/A    BETA, INC.   77   2025-02-15  edgar/data/77/0000000077-25-000009.txt", "10-K        GAMMA CO   9   2025-02-15  edgar/data/9/x.txt", "13F-HR      BAD DAY   5   2025-13-45  edgar/data/5/y.txt"]
    got = SRC.form_index(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.form, r.cik, r.accession) for r in got] == [("13F-HR", "0000001234", "0001234567-25-000001"), ("13F-HR/A", "0000000077", "0000000077-25-000009")]


def test_holdings_xml_and_cover(spark):
    xml = "<n1:informationTable><n1:infoTable><n1:nameOfIssuer>A</n1:nameOfIssuer><n1:cusip>03783310a</n1:cusip><n1:value>8,000,000</n1:value><n1:shrsOrPrnAmt><n1:sshPrnamt>10</n1:sshPrnamt><n1:sshPrnamtType>SH</n1:sshPrnamtType></n1:shrsOrPrnAmt></n1:infoTable><infoTable><cusip>1</cusip><value>3000000</value><sshPrnamt>5</sshPrnamt><putCall></putCall></infoTable></n1:informationTable>"
    got = SRC.holdings_xml(spark.createDataFrame([(1, xml), (2, None)], "id long, x string"), "id", "x").collect()
    assert [(r.cusip, r.value, r.shares, r.share_type, r.put_call) for r in got] == [("03783310A", 8000000, 10, "SH", None), ("1", 3000000, 5, None, None)]
    c = SRC.cover_page(spark.createDataFrame([(1, "<submissionType>13F-HR</submissionType><periodOfReport>12-31-2024</periodOfReport><tableValueTotal>11</tableValueTotal>"), (2, "CONFORMED PERIOD OF REPORT: 20240930")], "id long, x string"), "id", "x").orderBy("id").collect()
    assert (c[0].period, c[0].form, c[0].total_value, c[1].period, c[1].amendment) == (D(2024, 12, 31), "13F-HR", 11, D(2024, 9, 30), False)


def test_submissions(spark):
    j = '{"filings":{"recent":{"accessionNumber":["a","b"],"form":["13F-HR","10-K"],"filingDate":["2024-01-02","2024-01-03"]}}}'
    got = SRC.submissions(spark.createDataFrame([(1, j)], "id long, j string"), "id", "j").collect()
    assert [(r.accession, r.filed) for r in got] == [("a", D(2024, 1, 2))]


def test_json_diff_and_mapping(spark):
    df = lambda j: spark.createDataFrame([(1, j)], "id long, j string")
    got = {(r.path, r.left, r.right) for r in DOC.diff(df('{"a":{"b":1,"c":[1,2]},"d":null}'), df('{"a":{"b":2,"c":[1]}}'), "id", "j").collect()}
    assert {("a.b", "1", "2"), ("a.c[1]", "2", None)} <= got
    leaf = DOC.leaves(df('{"annual":{"2023":{"sales":5},"2024":{"sales":null}},"rest":[{"x":1}]}'), "id", "j")
    spec = [{"path": "annual.*.sales", "metric_key": "is.sales", "unit": "USD_millions", "null_as_zero": True}]
    assert {(r.context, r.value, r.unit) for r in DOC.mapped(leaf, spec, "id").collect()} >= {("2023", 5e6, "USD")}
    assert [r.path for r in DOC.unmapped(leaf, spec).collect()] == ["rest[].x"]


def test_fuzzy_ties(spark):
    left = spark.createDataFrame([(1, "blue river fund"), (2, "zzz"), (3, "red rock"), (4, "")], "l_id long, l_name string")
    right = spark.createDataFrame([(10, "blue river"), (11, "blue lake"), (12, "red rock"), (13, "red rock holdings")], "r_id long, r_name string")
    got = {r.l_id: (r.r_id, r.score) for r in MA.fuzzy(left, right, 0.7).collect()}
    assert got == {1: (10, 1.0), 3: (12, 1.0)}


def test_overlap_open_bounds(spark):
    rows = [("c", 1, None, D(2020, 1, 1)), ("c", 2, D(2020, 1, 1), None), ("c", 3, D(2021, 1, 1), D(2021, 2, 1)), ("d", 4, None, None)]
    got = {(r.ident, r.other) for r in MA.overlaps(spark.createDataFrame(rows, "k string, i long, a date, b date"), "k", "a", "b", "i").collect()}
    assert got == {(2, 1), (3, 2)}


def test_retries(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [(1, "ingest", "q1", "failed", t(1)), (2, "ingest", "q1", "failed", t(2)), (3, "ingest", "q2", "failed", t(1)), (4, "ingest", "q2", "succeeded", t(3)), (5, "other", "q3", "failed", t(1))]
    jobs = spark.createDataFrame(rows, "job long, kind string, lock_key string, status string, finished_at timestamp")
    assert [r.job for r in FI.retries(jobs, F.lit("2024-01-03 00:00:00").cast("timestamp"), ["ingest"]).collect()] == [2]


def test_streams_equal_batches(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.write.parquet(str(tmp_path / "in"))
    stream = RQ.budget(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "ts", 10, "1 hour", late="1 hour")
    q = stream.writeStream.format("memory").queryName("budget").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(spark.table("budget").collect()) == sorted(RQ.budget(batch, "ts", 10, "1 hour").collect())


def test_leaves_at_any_depth(spark):
    deep = '{"a":' * 60 + "7" + "}" * 60
    rows = [(1, deep), (2, '{"x": [1.50, {"y": true}, []], "z": null, "e": {}}'), (3, None), (4, "[]")]
    got = {(r.id, r.path): r.value for r in DOC.leaves(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()}
    assert got == {(1, ".".join(["a"] * 60)): "7", (2, "x[0]"): "1.50", (2, "x[1].y"): "true", (2, "z"): None}


def test_rating_days(spark):
    from tallyspark.functions import text as X

    notes = ["Lowered 3/31/23", "Raised 12/29/23", "New 2/30/24", "Suspended", None]
    got = [r.e for r in spark.createDataFrame([(x,) for x in notes], "n string").select(X.rating_event(F.col("n")).alias("e")).collect()]
    assert [(e.kind, e.day) for e in got] == [("lowered", D(2023, 3, 31)), ("raised", D(2023, 12, 29)), ("new", None), ("suspended", None), (None, None)]
