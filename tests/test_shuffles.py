"""Joins with a spec don't deal the rows by the few keys it has."""

from pyspark.sql import functions as F

from tallyspark.operators import documents as DOC
from tallyspark.operators import revisions as RV
from tallyspark.operators import rounds as RO
from tallyspark.operators import spec as SP
from tallyspark.plans import reports as R
from tallyspark.plans import revisions as RP
from tallyspark.sources import filings as SRC


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_leaves_are_not_shuffled_by_shape(spark):
    docs = spark.createDataFrame([(1, '{"a": {"k": 2}}'), (2, '{"b": {"k": 3, "l": 4}}')], "i long, j string")
    leaf = DOC.leaves(docs, "i", "j")
    out = DOC.mapped(leaf, [{"path": "*.k", "metric_key": "m", "unit": "percent"}], "i")
    assert "Exchange hashpartitioning" not in plan(out) and "SortMergeJoin" not in plan(out)
    assert sorted((r.i, r.context, r.value) for r in out.collect()) == [(1, "a", 0.02), (2, "b", 0.03)]
    assert {r.path for r in DOC.unmapped(leaf, [{"path": "*.k"}]).collect()} == {"b.l"}


def test_facts_are_not_shuffled_by_shape(spark):
    docs = spark.createDataFrame([(1, '{"header": {"rating": "A"}, "report_date": "2002-01-15"}')], "i long, j string")
    text = plan(SP.facts(docs, "i", "j", SP.compiled(R.SPEC, R.TAXONOMY)))
    assert "hashpartitioning(mask" not in text and "hashpartitioning(at" not in text


def test_merges_keep_off_the_driver(spark, monkeypatch):
    seen, kept = [], RO.cut
    monkeypatch.setattr(RO, "cut", lambda df: (seen.append(plan(df)), kept(df))[1])
    rows = spark.createDataFrame([(1, "a", "x", None, True), (2, "a", "y", "N", True), (3, "b", "y", None, True), (4, "c", "z", None, True)], "id long, t string, l string, e string, is_active boolean")
    refs = spark.createDataFrame([(3, 1.0), (4, 2.0)], "ref long, n double")
    out = RV.merged_entities(rows, "id", [["t"], ["l"]], ["e"], {"refs": (refs, "ref")})
    seen += [plan(out["entities"]), plan(out["refs"])]
    assert len(seen) > 4 and not any("Broadcast" in p for p in seen)
    assert sorted((r.id, r.e, r.is_active) for r in out["entities"].collect()) == [(1, "N", True), (2, "N", False), (3, None, False), (4, None, True)]
    assert sorted((r.ref, r.n) for r in out["refs"].collect()) == [(1, 1.0), (4, 2.0)]


def test_conflicts_hold_no_slot_in_memory(spark):
    """Only the count of values is aggregated by hash, in its two steps."""
    rows = spark.createDataFrame([(1, 5.0, "2020-01-02", 1), (1, 6.0, "2020-01-01", 2), (2, 5.0, "2020-01-01", 3), (2, 5.0, None, 4), (3, None, None, 5), (3, 1.0, None, 6), (3, 2.0, None, 7)], "s long, v double, d string, doc long")
    out = RV.actual_conflicts(rows, ["s"], "v", "d", "doc")
    assert plan(out).count("Aggregate") == 2
    assert sorted(map(tuple, out.collect())) == [(1, 5.0, 1, "2020-01-02", 6.0, 2, "2020-01-01"), (3, 2.0, 7, None, 1.0, 6, None)]


def test_log_is_not_sorted_to_find_letters(spark):
    """Greatest letters of a fact's lines, among them missing ones and letters beyond those asked for."""
    sf = "/root/testdata/sf0.001"
    log = RP._log(spark, sf)
    assert "SortAggregate" not in plan(log)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("r"), F.max("l_linestatus").alias("s"))
    want = lines.selectExpr("l_orderkey * 10 + l_linenumber", "if(r = 'R', 'manual', 'parsed')", "r = 'R' and s = 'F'").exceptAll(log.select("fact", "source_type", "is_current"))
    assert log.count() == lines.count() and want.isEmpty()


def test_log_with_odd_letters(spark, tmp_path):
    rows = [(1, 1, "R", "F"), (1, 1, "A", "F"), (2, 1, "R", "F"), (2, 1, "Z", "F"), (3, 1, None, "F"), (3, 1, "R", None), (4, 1, None, None), (5, 1, "R", "O"), (5, 1, "R", "F")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").withColumn("l_quantity", F.lit(2.0)).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.range(1, 6).selectExpr("id as o_orderkey", "id as o_custkey", "'F' as o_orderstatus", "timestamp'1995-01-02 00:00:00' as o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r.document, r.source_type, r.is_current) for r in RP._log(spark, str(tmp_path)).collect())
    assert got == [(1, "manual", True), (2, "parsed", False), (3, "manual", True), (4, "parsed", None), (5, "manual", False)]


def test_attributes_of_holdings_are_not_read(spark):
    """No field of a holding is an attribute; those that stand there, even with a field's name, change nothing."""
    xml = '<a:t xmlns:a="u" a:z="1"><a:infoTable cusip="no"><a:cusip nil="true">c1</a:cusip><a:value k="2">5</a:value><a:votingAuthority Sole="8"><a:Sole>1</a:Sole></a:votingAuthority></a:infoTable><a:infoTable cusip="only"/></a:t>'
    out = SRC.holdings_xml(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "i long, x string"), "i", "x")
    assert "(excludeAttribute,true)" in plan(out)
    assert [(r.i, r.cusip, r.value, r.voting_sole) for r in out.collect()] == [(1, "C1", 5, 1), (1, None, None, None)]
