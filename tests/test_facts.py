"""Facts of the catalogue's tables don't depend on the order of rows."""

import datetime

import pytest

from tallyspark.plans import analog as A
from tallyspark.plans.catalog import QUERIES

COLUMNS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
TAX = [0.08, 0.01, 0.03, 0.07, 0.02, 0.03]  # of mean 0.04, which doubles miss in one order or another


def lines(supplier, year, taxes, price=100.1):
    return [(i, i, supplier, 1, 50.0, price, t, t, "R", "F", datetime.datetime(year, 3, 1)) for i, t in enumerate(taxes)]


def written(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "s")], "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def orders(taxes):
    return [sorted(taxes), sorted(taxes, reverse=True), taxes, taxes[3:] + taxes[:3], taxes[::2] + taxes[1::2]]


@pytest.mark.parametrize("place", range(5))
def test_ties_are_ties_in_any_order(spark, tmp_path, place):
    one = orders(TAX)[place]
    sf = written(spark, tmp_path, lines(1, 1995, TAX) + lines(1, 1996, one * 3) + lines(1, 1997, TAX[::-1]))
    assert not QUERIES["k04_screen"](spark, sf).collect()  # a yield of 0.04 isn't above 0.04
    scores = QUERIES["m03_score_components"](spark, sf).orderBy("period_end").collect()
    assert [r.gross_margin_improving for r in scores] == [None, 0, 0]
    assert [r.cfo_positive for r in scores] == [1, 1, 1]


def test_large_and_missing_numbers_are_added_as_doubles(spark, tmp_path):
    rows = lines(1, 1995, [0.01, 0.02], 1e200) + lines(1, 1996, [0.1], float("nan")) + lines(1, 1997, [0.01, None], 1e-9)
    values = {(r.period_end.year, r.metric_key): r.value for r in A.facts(spark, written(spark, tmp_path, rows)).collect()}
    assert values[1995, "is.sales"] == 2e200 and str(values[1996, "is.sales"]) == "nan"
    assert values[1997, "is.sales"] == 2e-9 and values[1997, "val.dividend_yield"] == 0.01
