"""Loading, checking and running mappings."""

import datetime
import json
import time

import pytest

from tallyspark.operators import documents as DOC
from tallyspark.operators import spec as SP

D = datetime.date


def run(spark, report, mappings, taxonomy=None):
    df = spark.createDataFrame([(1, json.dumps(report))], "id long, j string")
    return {(r.path, r.metric_key): (r.value, r.text, r.period_type, r.period_end, r.nature) for r in SP.facts(df, "id", "j", SP.compiled({"mappings": mappings}, taxonomy)).collect()}


def mapping(**kw):
    return {"json_path": "y.*", "metric_key": "a.b", "value": {"numeric_from": "v"}, "period_type": "FY", "period_end_date": {"derive": "year_end_from_key"}, **kw}


def test_every_fault_is_told():
    spec = {"mappings": [mapping(id="a"), mapping(id="a", fact_nature="odd"), mapping(id="c", json_path="a..b"), mapping(metric_key="No"), mapping(value={}), mapping(period_end_date={"derive": "x"}), 5, mapping(metric_key_template="x.{metric_key}")]}
    with pytest.raises(SP.SpecError) as e:
        SP.compiled(spec, {"mapping_semantics": {"zz": {}, "c": {"storage_role": "no"}}})
    assert len(e.value.faults) == 10
    assert SP.read_text('{"mappings": []}') == {"mappings": []}


def test_periods_and_natures(spark):
    meta = {"fiscal_year_end_month": 6, "estimate_years": [2024], "actual_years": ["2022"], "historical_years": [2022, 2023]}
    report = {"annual_financials": {"meta": meta}, "y": {"2022": {"v": 1}, "2023": {"v": None}, "2024": {"v": "3"}, "x": {"v": 4}}}
    got = run(spark, report, [mapping()])
    assert got == {("y.2022", "a.b"): (1.0, None, "FY", D(2022, 6, 30), "actual"), ("y.2024", "a.b"): (3.0, None, "FY", D(2024, 6, 30), "estimate")}
    got = run(spark, report, [mapping(value={"numeric_from": "v", "null_as_zero": True})])
    assert got["y.2023", "a.b"] == (0.0, None, "FY", D(2023, 6, 30), None)
    got = run(spark, {"annual_financials": {"meta": {"historical_years": [2022, 2023]}}, "y": report["y"] | {"2023": {"v": 2}}}, [mapping(unit="USD_millions")])
    assert got["y.2023", "a.b"] == (2e6, None, "FY", D(2023, 12, 31), "estimate") and got["y.2022", "a.b"][4] is None
    assert run(spark, report, [mapping(fact_nature_rule="none")])["y.2022", "a.b"][4] is None
    assert run(spark, report, [mapping(id="m")], {"mapping_semantics": {"m": {"fact_nature": "opinion"}}})["y.2022", "a.b"][4] == "opinion"
    assert run(spark, report, [mapping(id="m"), mapping(metric_key="c.d")], {"mapping_semantics": {"m": {"storage_role": "evidence_only"}}}).keys() == {("y.2022", "c.d"), ("y.2024", "c.d")}


def test_context_of_items(spark):
    report = {
        "q": [{"calendar_year": 2021, "q1": {"v": 5, "period_end": "2021-03-31"}, "full_year": {"fact_nature": "estimate", "v": 9}}, {"label": "2022", "period_end": "2022-12-31", "fact_nature": "actual", "q1": {"v": 6}}, {"label": "FY 22", "q1": {"v": 7}}],
        "financial_position": {"years": ["2020", "2021-09-30"], "cash": [1, 2, 3]},
        "day": "2020-02-29",
        "k": [{"name": " dividend_yield ", "v": 2}, {"name": "Bad Key", "v": 3}],
    }
    by = lambda p, d, **kw: {"json_path": p, "metric_key": "a.b", "value": {"numeric_from": "v"}, "period_type": "Q", "period_end_date": d, **kw}
    got = run(spark, report, [by("q[].q1", {"derive": "year_end_from_context"}), by("q[]", {"derive": "quarter_end_from_context"}, metric_key="c.d", value={"numeric_from": "q1.v"})])
    assert got == {("q[0].q1", "a.b"): (5.0, None, "Q", D(2021, 12, 31), "estimate"), ("q[1].q1", "a.b"): (6.0, None, "Q", D(2022, 12, 31), "actual"), ("q[1]", "c.d"): (6.0, None, "Q", D(2022, 12, 31), "actual")}
    got = run(spark, report, [by("financial_position.cash[]", {"derive": "financial_position_date_from_index"}, value={"numeric_from": "$value"}, period_type="AS_OF")])
    assert got == {("financial_position.cash[0]", "a.b"): (1.0, None, "FY", D(2020, 12, 31), None), ("financial_position.cash[1]", "a.b"): (2.0, None, "AS_OF", D(2021, 9, 30), None)}
    got = run(spark, report, [by("k[]", {"from": "day"}, metric_key=None, metric_key_template="val.{metric_key}", metric_key_from="name")])
    assert got == {("k[0]", "val.dividend_yield"): (2.0, None, "Q", D(2020, 2, 29), None)}
    assert run(spark, report, [by("q[]", {}, period_type=None, value={"text_from": "day"})]) == {(f"q[{i}]", "a.b"): (None, "2020-02-29", None, None, n) for i, n in enumerate(["estimate", "actual", None])}


def test_large_spec_is_one_join(spark):
    rows = [(i, json.dumps({f"k{j}": {"2020": {"v": j}} for j in range(i, i + 40)})) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, j string")
    maps = [mapping(json_path=f"k{j}.*", metric_key=f"m.k{j}") for j in range(5000)]
    began = time.time()
    facts = SP.facts(df, "id", "j", SP.compiled({"mappings": maps}))
    facts._jdf.queryExecution().optimizedPlan()
    assert time.time() - began < 10
    assert facts.count() == 800 and facts.where("concat('m.k', cast(value as int)) != metric_key").isEmpty()
    leaf = DOC.leaves(df, "id", "j")
    old = [{"path": f"k{j}.*.v", "metric_key": f"k{j}", "unit": "USD"} for j in range(5000)]
    assert DOC.mapped(leaf, old, "id").count() == 800 and DOC.unmapped(leaf, old[:10]).count() == 49


def test_keys_with_signs(spark):
    report = {"rate (net)": 1, "x+y": 2, "a.b": 3, "a": {"b": 4}, "": 5, "*": 6, 'q"': 7, "l": [8, [9]], "\u0001": 10}
    leaf = DOC.leaves(spark.createDataFrame([(1, json.dumps(report))], "id long, j string"), "id", "j")
    paths = {r.path: r.value for r in leaf.collect()}
    assert len(paths) == 10 and paths['["a.b"]'] == "3" and paths["a.b"] == "4" and paths['[""]'] == "5" and paths["l[1][0]"] == "9"
    spec = [{"path": p, "metric_key": p, "unit": "USD"} for p in ("rate (net)", "x+y", "a.b", '["a.b"]', "l[]", "l[1][]", '["*"]', '["q\\""]')]
    got = {r.metric_key: r.value for r in DOC.mapped(leaf, spec, "id").collect()}
    assert got == {"rate (net)": 1.0, "x+y": 2.0, "a.b": 4.0, '["a.b"]': 3.0, "l[]": 8.0, "l[1][]": 9.0, '["*"]': 6.0, '["q\\""]': 7.0}


def test_very_deep_beside_good(spark):
    n = 100_000
    deep = '{"a": ' + "[" * n + '"x", {"k": [true, null, -1.5e3]}' + "]" * n + "}"
    df = spark.createDataFrame([(1, deep), (2, '{"b": 1}'), (3, None), (4, "[]")], "id long, j string")
    got = [(r.id, len(r.path), r.value) for r in DOC.leaves(df, "id", "j").collect()]
    base = 1 + 3 * (n - 1)
    assert got == [(1, base + 3, "x"), (1, base + 8, "true"), (1, base + 8, None), (1, base + 8, "-1.5e3"), (2, 1, "1")]
    for bad in ('{"a": [}', "[" * n, "[" * n + "]" * n + "x", '{"a" 1}'):
        with pytest.raises(Exception):
            DOC._parsed(bad)
