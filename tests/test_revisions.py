"""Assignments, corrections, clean-up and merges against plain loops over lists."""

import datetime
import random

from pyspark.sql import functions as F

from tallyspark.operators import consensus as C
from tallyspark.operators import latest as L
from tallyspark.operators import revisions as RV
from tallyspark.operators import rounds as RO
from tallyspark.streaming import requests as RQ

T0 = datetime.datetime(2024, 1, 1)


def test_one_to_one_equals_greedy(spark):
    rng = random.Random(1)
    pairs = [(a, f"c{rng.randrange(30)}", rng.randrange(8)) for a in range(40) for _ in range(6)]
    pairs = list({(a, b): (a, b, s) for a, b, s in pairs}.values()) + [(None, "c1", 9), (50, None, 9)]
    want, left, right = set(), set(), set()
    for a, b, s in sorted([p for p in pairs if None not in p], key=lambda p: (-p[2], p[0], p[1])):
        if s >= 2 and a not in left and b not in right:
            want.add((a, b, s))
            left.add(a)
            right.add(b)
    got, rounds = RO.one_to_one(spark.createDataFrame(pairs, "left long, right string, score long").repartition(5), 2)
    assert {(r.left, r.right, r.score) for r in got.collect()} == want and got.count() == len(want)
    assert 1 < rounds < 12 and got.agg(F.max("round")).first()[0] == rounds
    none, n = RO.one_to_one(spark.createDataFrame([], "left long, right string, score double"))
    assert none.count() == 0 and n == 0


def test_settled_candidates_equal_the_sequence(spark):
    rng = random.Random(2)
    best = [(i, f"c{rng.randrange(25)}", rng.choice([0.5, 0.6, 0.7, 0.85, 0.9])) for i in range(120)]
    owned = [(200, "c1"), (3, best[3][1])]
    taken, want = {}, []
    for i, c in owned:
        taken.setdefault(c, set()).add(i)
    for i, c, s in best:
        if s < 0.6:
            want.append((i, "none"))
        elif taken.get(c, set()) - {i}:
            want.append((i, "conflict"))
        else:
            want.append((i, "confirmed" if s >= 0.85 else "candidate"))
            if s >= 0.85:
                taken.setdefault(c, set()).add(i)
    got = RO.settled_candidates(spark.createDataFrame(best, "ident long, code string, score double"), spark.createDataFrame(owned, "ident long, code string"))
    # one that owned its code from the start keeps later ones away, however it was scored
    assert sorted((r.ident, r.status) for r in got.collect()) == want


def filings(rng, n=200):
    return [(i, i % 7, rng.choice([1, 2, 3, 4]), T0 + datetime.timedelta(hours=rng.randrange(50))) for i in range(n)]


def ranks(rows):
    out, slots = {}, {}
    for f, m, p, at in rows:
        slots.setdefault((m, p), []).append((at, f))
    for (m, p), members in slots.items():
        for k, (_, f) in enumerate(sorted(members)):
            out[f] = (m, p, k + 1, k + 1 == len(members))
    return out


def test_period_correction_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    index = filings(rng)
    said = {f: rng.choice([1, 2, 3, 5]) for f, m, *_ in index if f % 3 == 0 and m != 2}
    want = ranks([(f, m, said.get(f, p), at) for f, m, p, at in index])
    df = RV._ranks(spark.createDataFrame(index, "filing long, manager long, period long, filed_at timestamp"))
    covers = spark.createDataFrame([*said.items(), (1, None), (999, 4)], "filing long, period long")
    once = RV.corrected_periods(df, covers)
    assert {r.filing: (r.manager, r.period, r.version_rank, r.is_latest) for r in once.collect()} == want
    assert sorted(map(tuple, RV.corrected_periods(once, covers).collect())) == sorted(map(tuple, once.collect()))

    manager = {f: m for f, m, *_ in index}
    events = [("index", f, m, p, at) for f, m, p, at in index] + [("cover", f, manager[f], p, None) for f, p in said.items()]
    rng.shuffle(events)
    schema = "kind string, filing long, manager long, period long, filed_at timestamp"
    stream = RV.PeriodStream(str(tmp_path / "state"), buckets=4)
    parts = [events[i::4] for i in range(4)] + [events[:10]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    for i in range(len(parts)):
        query = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / f"b{i}")).writeStream.foreachBatch(stream.apply).option("checkpointLocation", str(tmp_path / "cp" / str(i))).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r.filing: (r.manager, r.period, r.version_rank, r.is_latest) for r in stream.filings(spark).collect()} == want
    assert stream.ranked[-1] == 0  # the repeated batch ranked nothing
    stream.apply(spark.createDataFrame([("cover", 0, 0, 4, None)], schema))
    old, new = said.get(0, index[0][2]), max(said.get(0, 0), 4)
    touched = sum(m == 0 and p in (old, new) for m, p, *_ in want.values())
    assert stream.ranked[-1] == (touched if old != new else 0)


SLOT = "user long, stock long, metric_key string, period_type string, period_end date, as_of date"
FACTS = f"fact long, {SLOT}, value double, source_type string, document long, is_current boolean"
Y = datetime.date(2023, 12, 31)


def double(pairs):
    w = pairs.where("is_current and metric_key = 'in'").groupBy("user", "stock", "period_end").agg(F.max("value").alias("v"))
    return w.selectExpr("cast(null as long) fact", "user", "stock", "'out' metric_key", "'FY' period_type", "period_end", "cast(null as date) as_of", "v * 2 value", "'calculated' source_type", "cast(null as long) document", "true is_current")


def test_manual_correction(spark):
    rows = [(10 * s + k, 1, s, key, "FY", Y if k else None, None, float(s), "parsed", 7, True) for s in range(1, 5) for k, key in enumerate(["in", "in", "other"])]
    stale = [(None, 1, s, "out", "FY", Y, None, -1.0, "calculated", None, True) for s in range(1, 5)]
    facts = spark.createDataFrame(rows + stale, FACTS)
    fixes = spark.createDataFrame([(11, 100, 50.0), (11, 101, 60.0), (22, 102, 9.0), (30, 103, 8.0), (999, 104, 1.0)], "fact long, new_fact long, value double")
    out = RV.corrected_facts(facts, fixes, double, ["in"])
    got = {r.fact: r for r in out.where("fact is not null").collect()}
    assert len(got) == 16 and not got[11].is_current and not got[100].is_current and got[101].is_current and got[101].source_type == "manual" and got[101].document == 7
    assert got[10].is_current and not got[30].is_current and got[103].is_current and got[103].period_end is None and not got[22].is_current
    derived = {(r.stock, r.period_end): r.value for r in out.where("metric_key = 'out'").collect()}
    # pairs with a corrected input are derived anew, the others keep even a stale fact
    assert derived == {(1, None): 2.0, (1, Y): 120.0, (2, Y): -1.0, (3, None): 16.0, (3, Y): 6.0, (4, Y): -1.0}
    whole = double(out.where("source_type != 'calculated'"))
    changed = out.where("metric_key = 'out' and stock in (1, 3)")
    assert sorted(map(str, changed.collect())) == sorted(map(str, whole.where("stock in (1, 3)").select(*out.columns).collect()))
    again = RV.corrected_facts(out, fixes, double, ["in"])
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


DOCS = "document long, user long, stock long, report_date date, parse_status string, uploaded timestamp"


def test_document_cleanup(spark):
    d = datetime.date(2024, 1, 5)
    docs = [(1, 1, 1, d, "parsed", T0), (2, 1, 1, d, "parsed_partial", T0 + datetime.timedelta(1)), (3, 1, 1, d, "parsed", None), (4, 1, 2, d, "failed", T0), (5, 1, None, d, "parsed", T0), (6, 1, None, d, "parsed", T0), (7, 2, 1, d, "parsed", T0), (8, 1, 1, datetime.date(2023, 1, 1), "parsed", T0)]
    fact = lambda i, key, doc, kind, current, end=Y: (i, 1, 1, key, "FY", end, None, float(i), kind, doc, current)
    facts = [fact(1, "a", 2, "parsed", True), fact(2, "a", 8, "parsed", False), fact(3, "b", 2, "parsed", True), fact(4, "b", 1, "parsed", False), fact(5, "b", 8, "manual", True), fact(6, "c", 3, "manual", True), fact(7, "d", 3, "manual", True), fact(8, "d", 1, "parsed", False), fact(9, "e", None, "manual", True), fact(10, "f", 2, "manual", True, None), fact(11, "f", 1, "manual", False, None), fact(12, "in", 1, "parsed", True), (None, 1, 1, "out", "FY", Y, None, -1.0, "calculated", None, True), (None, 2, 1, "out", "FY", Y, None, -1.0, "calculated", None, True)]
    tables = {"documents": spark.createDataFrame(docs, DOCS), "facts": spark.createDataFrame(facts, FACTS), "pages": spark.createDataFrame([(i, 1) for i in range(1, 9)], "document long, page long")}
    plan = RV.cleaned_documents(tables, double, apply=False)
    assert set(plan) == {"plan", "unmoved"}
    out = RV.cleaned_documents(tables, double)
    pairs = {(r.document, r.kept) for r in out["plan"].collect()}
    assert pairs == {(2, 1), (3, 1)} == {(r.document, r.kept) for r in plan["plan"].collect()}
    got = {r.fact: (r.document, r.is_current) for r in out["facts"].where("fact is not null").collect()}
    assert got == {2: (8, True), 4: (1, False), 5: (8, True), 6: (1, True), 7: (None, True), 8: (1, False), 9: (None, True), 10: (1, True), 11: (1, False), 12: (1, True)}
    assert [r.fact for r in out["unmoved"].collect()] == [7]
    assert {(r.user, r.value) for r in out["facts"].where("metric_key = 'out'").collect()} == {(1, 24.0), (2, -1.0)}
    assert sorted(r.document for r in out["pages"].collect()) == [1, 4, 5, 6, 7, 8] == sorted(r.document for r in out["documents"].collect())
    again = RV.cleaned_documents({k: out[k] for k in tables}, double)
    assert again["plan"].isEmpty() and all(sorted(map(str, again[k].collect())) == sorted(map(str, out[k].collect())) for k in tables)


def test_merged_entities(spark):
    rows = [(1, "A", "US", None, None, True), (2, "A", "US", "L1", "N", True), (3, "B", "US", "L1", None, True), (4, "B", "US", None, "Q", True), (5, "A", "US", None, "Z", False), (6, "C", None, None, None, True), (7, "C", None, None, None, True), (9, "D", "UK", "L9", None, True)]
    rows += [(100 + i, f"T{i // 2}", "X", f"K{(i + 1) // 2}", f"e{i}", True) for i in range(41)]  # one long chain
    stocks = spark.createDataFrame(rows, "id long, ticker string, market string, listing string, exchange string, is_active boolean").repartition(7)
    prices = spark.createDataFrame([(i, i and i * 2) for i in (1, 2, 3, 4, 5, 9, 140, None)], "stock_id long, x long")
    out = RV.merged_entities(stocks, "id", [["ticker", "market"], ["listing"]], ["exchange"], {"prices": (prices, "stock_id")})
    to = {r.id: r.survivor for r in out["survivors"].collect()}
    assert to == {2: 1, 3: 1, 4: 1, **{100 + i: 100 for i in range(1, 41)}}
    ent = {r.id: (r.exchange, r.is_active) for r in out["entities"].collect()}
    assert len(ent) == len(rows) and ent[1] == ("N", True) and ent[2] == ("N", False) and ent[5] == ("Z", False) and ent[6] == (None, True) and ent[100] == ("e0", True)
    assert sorted((r.stock_id or -1, r.x or -1) for r in out["prices"].collect()) == [(-1, -1), (1, 2), (1, 4), (1, 6), (1, 8), (5, 10), (9, 18), (100, 280)]
    alive = {i for i, (_, a) in ent.items() if a}
    assert all(r.stock_id is None or r.stock_id in alive | {5} for r in out["prices"].collect())
    once = RV.merged_entities(out["entities"], "id", [["ticker", "market"], ["listing"]], ["exchange"], {})
    assert once["survivors"].isEmpty()


def test_conflicts_versions_places_and_rolling(spark):
    d = datetime.date
    obs = [(1, 5.0, d(2024, 1, 1), 1), (1, 6.0, d(2024, 2, 1), 2), (1, 6.0, None, 9), (2, 5.0, d(2024, 1, 1), 1), (2, 5.0, d(2024, 1, 2), 2), (3, None, d(2024, 1, 1), 1), (3, 1.0, d(2024, 1, 1), 2)]
    got = {r.s: (r.current_value, r.current_document, r.previous_value, r.previous_day) for r in RV.actual_conflicts(spark.createDataFrame(obs, "s long, v double, day date, doc long"), ["s"], "v", "day", "doc").collect()}
    assert got == {1: (6.0, 2, 5.0, d(2024, 1, 1)), 3: (1.0, 2, None, d(2024, 1, 1))}
    v = spark.createDataFrame([(1, 1, "v9"), (1, 2, "v10"), (2, 1, None), (2, 2, "beta"), (3, 5, "v7"), (3, 6, "x7"), (4, 1, "v" + "9" * 30), (4, 2, "v1")], "k long, id long, v string")
    assert sorted((r.k, r.id) for r in L.newest_version(v, ["k"], "v", "id").collect()) == [(1, 2), (2, 2), (3, 6), (4, 1)]
    rng = random.Random(6)
    rows = [(i, None if i % 9 == 0 else float(rng.randrange(40))) for i in range(500)]
    got = {r.i: r.place for r in L.placed(spark.createDataFrame(rows, "i long, v double"), "v", "i").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(order)}
    times = [T0 + datetime.timedelta(microseconds=rng.randrange(10**9)) for _ in range(300)] + [T0] * 5 + [T0 + datetime.timedelta(seconds=60)]
    got = {r.i: (r.used, r.remaining) for r in RQ.rolling_budget(spark.createDataFrame(list(enumerate(times)), "i long, ts timestamp"), "ts", "i", 20).collect()}
    used = [sum(t - datetime.timedelta(seconds=60) <= u <= t for u in times) for t in times]
    assert got == {i: (n, max(20 - n, 0)) for i, n in enumerate(used)}


def test_positions_of_large_and_small_values(spark):
    rows = [("m", "a", 1, 0.00003, 3e14), ("m", "a", 1, 0.00003, 0.1), ("m", "b", 1, 1.0, 1e17), ("m", "c", 1, None, 2.0), ("n", "a", 1, 2.0, 1.0), ("o", "a", 1, 1.0, float("nan"))]
    got = {(r.manager, r.stock): (r.shares, r.value) for r in C.positions(spark.createDataFrame(rows, "manager string, stock string, period int, shares double, value double")).collect()}
    assert got["m", "a"] == (0.00006, 300000000000000.1) and got["m", "b"] == (1.0, 1e17) and got["m", "c"] == (None, 2.0) and got["n", "a"] == (2.0, 1.0)
    many = spark.createDataFrame([("m", "a", 1, 0.1, 9e14)] * 20_000, "manager string, stock string, period int, shares double, value double")
    assert C.positions(many).first().value == 1.8e19 and C.positions(many).first().shares == 2000.0


def test_rolling_budgets_are_running_sums(spark):
    from datetime import datetime, timedelta

    from tallyspark.streaming import requests as RQ

    start = datetime(2024, 1, 1)
    micros = [0, 0, 1, 9_999_999, 10_000_000, 10_000_001, 19_999_999, 19_999_999, 20_000_000, 20_000_001, 29_999_998, 40_000_000, 50_000_000, 50_000_001]
    rows = [(i, start + timedelta(microseconds=m)) for i, m in enumerate(micros)]
    out = RQ.rolling_budget(spark.createDataFrame(rows, "i long, ts timestamp"), "ts", "i", 3, 10)
    # no frame that is added up anew for every time in it
    assert "RangeFrame, -" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {i: sum(m - 10_000_000 <= x <= m for x in micros) for i, m in enumerate(micros)}
    assert {r.i: r.used for r in out.collect()} == want
    assert all(r.remaining == max(3 - r.used, 0) for r in out.collect())
