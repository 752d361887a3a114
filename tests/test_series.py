"""Runs of years, labelled rows, year maps and column tables in page texts."""

import datetime
import random
import re

from pyspark.sql import functions as F

from tallyspark.functions import series as SE


def plain_run(text, gap=12, least=6):
    """The rule by one pass over the positions."""
    flat, runs, last = re.sub(r"\s+", " ", text), [], None
    for m in re.finditer(r"20[0-9]{2}", flat):
        if last is not None and m.start() - last <= gap:
            runs[-1].append(int(m[0]))
        else:
            runs.append([int(m[0])])
        last = m.start()
    runs = [list(dict.fromkeys(r)) + [len(r)] for r in runs if len(r) >= least]
    return max(runs, key=lambda r: (len(r) - 1, r[-1]))[:-1] if runs else []


def test_year_runs(spark):
    rng = random.Random(4)
    pieces = ["2019", "2020", "20", "1", " ", "  \n", "B", "2021", "2022", "2005", ", ", "a long way off ", "20202", "est."]
    texts = ["".join(rng.choices(pieces, k=60)) for _ in range(300)]
    texts += ["201520162017201820192020B", "", "2019 " * 20_000, "2015 2016 2017 2018 2019 and then 2020 2021 2022 2023 2024 2025 2025", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.y for r in df.select("i", SE.year_run(F.col("t")).alias("y")).collect()}
    assert got == {i: None if t is None else plain_run(t) for i, t in enumerate(texts)}


def series(spark, text, label="Sales", **kw):
    r = SE.labelled_series(spark.createDataFrame([(text,)], "t string"), "t", label, **kw).first()
    return dict(zip(r.years, r.series)), r.projection


def test_labelled_series(spark):
    head = "201820192020202120222023 "
    assert series(spark, head + "Debt 1.5 2.5 d3.5 NMF 31.q .7 Sales 9.5") == ({2018: 1.5, 2019: 2.5, 2020: -3.5, 2021: None, 2022: 31.9, 2023: 0.7}, 9.5)
    assert series(spark, head + "Debt 1 2 3 4 5 Sales")[0] == {2018: 1, 2019: 2, 2020: 3, 2021: 4, 2022: 5, 2023: None}
    assert series(spark, head + "Debt 1 2 3 Sales x 7")[0] == {2018: None, 2019: None, 2020: None, 2021: 1, 2022: 2, 2023: 3}
    assert series(spark, head + "Debt 1 2 3 Sales", missing_last_year=True)[0] == {2018: 1, 2019: 2, 2020: 3, 2021: None, 2022: None, 2023: None}
    assert series(spark, head + "Debt 9 1 2 3 4 5 6 Sales")[0] == {2018: 1, 2019: 2, 2020: 3, 2021: 4, 2022: 5, 2023: 6}
    assert series(spark, head + "SomePress 9 1 2 3 4 5 6 Sales", not_label="press")[0] == series(spark, head + "Debt 1 2 3 4 5 6 Sales")[0]
    assert series(spark, head + "SomePress 1 2 3 4 5 6 Sales", missing_last_year=True, not_label="press")[0][2018] == 1
    assert series(spark, head + "Debt 10% 2 .5 4 5 60% Sales 12%", percent=True) == ({2018: 0.1, 2019: 0.02, 2020: 0.5, 2021: 0.04, 2022: 0.05, 2023: 0.6}, 0.12)
    assert series(spark, head + "Debt 1 2 3") == (dict.fromkeys(range(2018, 2024)), None)
    assert series(spark, "no years Sales 3") == ({}, None)
    long = "".join(str(y) for y in range(2005, 2021)) + " Debt " + " ".join(str(y - 2000) for y in range(2005, 2021)) + " Sales"
    assert series(spark, long)[0] == {y: y - 2000 for y in range(2009, 2021)}


def test_year_maps(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2019, 2020, 2021], 5.0), ([1.0, 2.0, 3.0, 4.0], [2019, 2019], None), (None, [2019], 1.0), ([], [], None)], "s array<double>, y array<int>, p double")
    got = [r.m for r in df.select(SE.year_map(F.col("s"), F.col("y"), F.col("p")).alias("m")).collect()]
    assert got == [{"2019": 1.0, "2020": 2.0, "2021": None, "projection": 5.0}, {"2019": 2.0}, None, {}]
    got = df.limit(1).select(SE.year_map(F.col("s"), F.col("y"), drop_trailing_null=True).alias("m")).first().m
    assert got == {"2019": 1.0, "2020": 2.0}
    group = {"a": F.col("s"), "b": F.transform("s", lambda x: F.lit(None).cast("double")), "c": F.lit(None).cast("array<double>")}
    got = df.limit(1).select(SE.group_year_maps(group, F.col("y"), renamed={"a": "z"}, drop_all_null=True).alias("m")).first().m
    assert set(got) == {"z"}
    got = df.limit(1).select(SE.group_year_maps(group, F.col("y"), drop_all_null=True, kept=("b",)).alias("m")).first().m
    assert set(got) == {"a", "b"}


def test_grid(spark):
    text = "\n".join([
        "CURRENT POSITION   2022      2023    9/30/24",
        "($MILL.)",
        "Cash Assets        12.5      13.0     d14.5",
        "Receivables                  20.0      21.0",
        "Inventory (LIFO)   --                 7",
        "Other              1 2 3 4",
        "                   1.0       2.0       3.0",
        "Twice              1.0  2.0",
    ])
    got = [tuple(r)[2:] for r in SE.grid(spark.createDataFrame([(1, text), (2, "no header\nCash 1 2 3"), (3, None)], "i long, t string"), "i", "t").orderBy("line").collect()]
    assert got[:3] == [("Cash Assets", "2022", 12.5, "ok"), ("Cash Assets", "2023", 13.0, "ok"), ("Cash Assets", "9/30/24", -14.5, "ok")]
    assert got[3:7] == [("Receivables", "2023", 20.0, "ok"), ("Receivables", "9/30/24", 21.0, "ok"), ("Inventory (LIFO)", "2022", None, "ok"), ("Inventory (LIFO)", "9/30/24", 7.0, "ok")]
    assert got[7:] == [("Other", None, None, "broken"), ("", None, None, "broken"), ("Twice", None, None, "broken")]
    day = spark.createDataFrame([("2022",), ("9/30/24",), ("x",)], "h string").select(SE.column_day(F.col("h"))).collect()
    assert [r[0] for r in day] == [datetime.date(2022, 12, 31), datetime.date(2024, 9, 30), None]


def test_quarterly(spark):
    text = "Cal- QUARTERLY SALES Mar.Per Jun.Per Sep.Per Dec.Per Full\n2022  1.5 d2.5 NMF .5  4.0 note\n2023  1 2 3\n 2024 1 2 3 4\n2025 next words"
    got = [tuple(r)[2:] for r in SE.quarterly(spark.createDataFrame([(1, text)], "i long, t string"), "i", "t").orderBy("line").collect()]
    assert got == [(2022, 1, "Mar", 12, 1.5, "ok"), (2022, 2, "Jun", 12, -2.5, "ok"), (2022, 3, "Sep", 12, None, "ok"), (2022, 4, "Dec", 12, 0.5, "ok"), (2022, None, None, 12, 4.0, "ok"), (2023, None, None, 12, None, "broken"), (2024, 1, "Mar", 12, 1.0, "ok"), (2024, 2, "Jun", 12, 2.0, "ok"), (2024, 3, "Sep", 12, 3.0, "ok"), (2024, 4, "Dec", 12, 4.0, "ok")]
