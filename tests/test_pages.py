"""Read models on hand-made rows."""

import datetime
import json

from pyspark.sql import functions as F

from tallyspark.operators import pages as P

D = datetime.date
FACTS = "fact long, stock long, metric_key string, value double, period_type string, period_end date, created date, source_type string, document long, is_current boolean, nature string"
PRICES = "stock long, day date, close double, created long"
DOCS = "document long, report_date date"


def fact(i, key, value, end=D(2023, 12, 31), created=D(2024, 1, 1), kind="parsed", doc=1, current=True, nature="actual", stock=1, period="FY"):
    return (i, stock, key, value, period, end, created, kind, doc, current, nature)


def test_active_report(spark):
    facts = spark.createDataFrame([fact(1, "a", 1.0, doc=1), fact(2, "a", 1.0, doc=2), fact(3, "a", 1.0, doc=3), fact(4, "a", 1.0, doc=4, kind="manual"), fact(5, "a", 1.0, doc=9, stock=2), fact(6, "a", 1.0, doc=8, stock=2)], FACTS)
    docs = spark.createDataFrame([(1, D(2024, 1, 1)), (2, D(2024, 1, 1)), (3, None), (4, D(2025, 1, 1)), (8, None), (9, None)], DOCS)
    assert {tuple(r) for r in P.active_reports(facts, docs).collect()} == {(1, 2, D(2024, 1, 1)), (2, 9, None)}


def test_overlay_and_valuation(spark):
    facts = spark.createDataFrame([
        fact(1, P.QUALITY["piotroski_total"], 6.0, D(2022, 12, 31)), fact(2, P.QUALITY["piotroski_total"], 8.0, D(2023, 12, 31), doc=5), fact(3, P.QUALITY["piotroski_total"], 9.0, D(2024, 12, 31), current=False), fact(4, P.QUALITY["piotroski_total"], None, D(2025, 12, 31)),
        fact(5, P.QUALITY["owners_earnings"], 5.0, doc=2), fact(6, P.FAIR_VALUE, 50.0, kind="parsed"), fact(7, P.TARGET, 40.0, created=D(2024, 1, 1)), fact(8, P.TARGET, 80.0, end=D(2020, 1, 1), created=D(2024, 2, 1)), fact(9, P.FAIR_VALUE, 20.0, kind="manual", stock=2),
    ], FACTS)
    prices = spark.createDataFrame([(1, D(2024, 1, 1), 10.0, 1), (1, D(2024, 1, 1), 20.0, 2), (1, D(2024, 3, 1), 99.0, 1), (3, D(2024, 1, 1), 0.0, 1)], PRICES)
    until = F.lit(D(2024, 2, 1))
    got = {r.stock: r for r in P.quality_overlay(spark.createDataFrame([(1,), (1,), (2,), (3,)], "stock long"), facts, prices, until).collect()}
    assert len(got) == 3
    one = got[1]
    assert (one.piotroski_total, one.latest_price, one.owner_earnings_yield, one.available_metrics, one.has_report) == (8.0, 20.0, 0.25, 2, True)
    assert one.unavailable_reasons == [] and one.source_documents == [2, 5] and one.primary_document == 2 and [p.label for p in one.provenance] == ["piotroski_total", "owners_earnings"]
    assert got[2].unavailable_reasons == ["missing report facts", "missing price", "missing normalized owner earnings"] and not got[2].has_report
    assert got[3].latest_price == 0.0 and got[3].owner_earnings_yield is None
    ranges = spark.createDataFrame([(1, 25.0, 30.0), (2, None, None), (3, 1.0, 2.0)], "stock long, holder_low double, holder_high double")
    got = {r.stock: r for r in P.valuation_reference(ranges, facts, prices, until).collect()}
    assert (got[1].valuation_reference, got[1].reference_type, got[1].discount_to_reference, got[1].below_holder_estimate, got[1].below_reference) == (80.0, "analyst_target_reference", 0.75, True, True)
    assert (got[2].valuation_reference, got[2].reference_type, got[2].discount_to_reference) == (20.0, "manual_intrinsic_value", None) and got[2].unavailable_reasons == ["missing price", "missing holder price estimate"]
    assert got[3].reference_type == "missing" and got[3].below_holder_estimate and not got[3].below_reference


def test_score_card(spark):
    def score(i, key, year, value, **kw):
        return fact(i, key, value, D(year, 12, 31), kind="calculated", **kw)

    rows = [score(i, "c1", 2015 + i, 1.0) for i in range(8)] + [score(20, "c2", 2022, 0.0), score(21, "c2", 2021, 1.0, nature="estimate"), score(22, "t", 2021, 7.0), score(23, "c3", 2000, 1.0), score(24, "c4", 2022, None), score(25, "c1", 2022, 0.0, created=D(2020, 1, 1))]
    got = {r.metric_key: r for r in P.score_card(spark.createDataFrame(rows, FACTS), ["c1", "c2", "c3", "c4"], "t").collect()}
    assert got["c1"].years == [2018, 2019, 2020, 2021, 2022] and (got["c1"].status, got["c1"].level) == ("success", "all")
    assert got["c2"].scores == [None, None, None, 1.0, 0.0] and got["c2"].natures[3] == "estimate" and got["c2"].status == "danger"
    assert (got["c3"].status, got["c3"].scores) == ("warning", [None] * 5) and got["c4"].status == "warning"
    assert (got["t"].status, got["t"].level) == ("secondary", "strong")
    assert P.score_card(spark.createDataFrame([], FACTS), ["c1"], "t").isEmpty()
    kept = P.compared_years(spark.createDataFrame(rows[:8] + [score(30 + i, "c1", 2024 + i, 1.0, nature="estimate") for i in range(3)] + [score(40, "c1", 2001, 1.0, nature=None)], FACTS))
    assert sorted(r.fact for r in kept.collect()) == [3, 4, 5, 6, 7, 30, 31]


def test_stock_page(spark):
    year = lambda y: D(y, 12, 31)
    rows = [fact(i, P.SERIES, v, year(2015 + i), kind="calculated") for i, v in enumerate([9.0, 5.0, None, 4.0, 3.0, 3.0, 8.0])]
    rows += [fact(20, P.DCF["net_profit_per_share"], 2.0, year(2021)), fact(21, P.DCF["depreciation"], 30.0, year(2021)), fact(22, P.DCF["shares_outstanding"], 10.0, year(2021)), fact(23, P.DCF["depreciation"], 30.0, year(2020)), fact(24, P.DCF["shares_outstanding"], 0.0, year(2020))]
    rows += [fact(30, P.GROWTH["revenues"], 0.05), fact(31, P.GROWTH["earnings"], 0.03), fact(32, P.GROWTH["cash_flow"], 0.03), fact(33, "mkt.price", 12.0), fact(34, P.GROWTH["sales"], 0.9, current=False)]
    stocks = spark.createDataFrame([(1, "A", "US", None, "Co"), (2, "B", "US", "NYSE", None)], "stock long, ticker string, exchange string, listing_exchange string, company string")
    prices = spark.createDataFrame([(1, D(2024, 1, 2), 5.0, 1), (1, D(2024, 1, 2), 6.0, 2), (1, D(2024, 1, 9), 7.0, 1)], PRICES)
    docs = spark.createDataFrame([(1, D(2024, 1, 1))], DOCS)
    got = {r.stock: r for r in P.stock_pages(stocks, spark.createDataFrame(rows, FACTS), prices, docs, F.lit(D(2024, 1, 2))).collect()}
    one = got[1]
    assert [(s.year, s.value) for s in one.series] == [(2021, 8.0), (2020, 3.0), (2019, 3.0), (2018, 4.0), (2017, 0.0), (2016, 5.0)]
    # five newest in order: 0, 3 (2019), 3 (2020), 4, 8
    assert one.dcf_year == 2020 and one.series[0].depreciation == 3.0 and one.series[0].depreciation_source == "computed" and one.series[1].depreciation_source == "missing" and one.series[0].capex_source == "missing"
    assert [(g.key, round(g.value, 6)) for g in one.growth] == [("revenues", 5.0), ("cash_flow", 3.0), ("earnings", 3.0)] and one.growth_default == "cash_flow"
    assert (one.latest_price, one.latest_price_date, one.based_on, one.active_document, one.exchange) == (6.0, D(2024, 1, 2), 8.0, 1, "US")
    assert got[2].exchange == "NYSE" and got[2].series is None and got[2].latest_price is None


def test_bars_and_quarters(spark):
    t = int(datetime.datetime(2024, 1, 3, 4, 30, tzinfo=datetime.timezone.utc).timestamp())  # the evening of the 2nd in New York
    chart = lambda ts, **q: json.dumps({"chart": {"result": [{"timestamp": ts, "indicators": {"quote": [q]}}]}})
    rows = [("A", chart([t, t + 60], open=[1.0, 2.0], high=[1.0], low=[0.5, 0.6], close=[None, 3.0], volume=[7])), ("B", chart([t], open=[None], close=[1.0])), ("C", "oops"), ("D", chart([t + 86400], close=[1.0])), ("E", chart([], close=[])), ("F", None), ("G", chart([t], close=[4.0]))]
    got = P.picked_bars(spark.createDataFrame(rows, "s string, j string"), "s", "j", F.lit(D(2024, 1, 2)))
    assert sorted(map(tuple, got.collect())) == [("A", 2.0, 3.0, 0.6, 3.0, 0.0), ("G", 4.0, 4.0, 4.0, 4.0, 0.0)]
    df = spark.createDataFrame([(D(2024, 3, 31), "2024-q1"), (D(2024, 4, 1), "2024-Q1"), (D(2024, 1, 1), "2024Q1")], "d date, l string")
    assert [r[0] for r in df.select(P.in_quarter(F.col("d"), F.col("l"))).collect()] == [True, False, None]
