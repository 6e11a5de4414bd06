import math

import pytest
from pyspark.sql import functions as F

from evenlend.functions import formulas as fm, missing as m, rowwise as rw, scalars as sc


def one(df, *exprs):
    return tuple(df.select(*exprs).first())


def test_ieee_division_on_edge_pairs(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (None, 0.0), (1.0, 2.0), (1.0, None), (float("nan"), 0.0)], "x double, y double"
    )
    got = [r[0] for r in df.select(m.ieee_div(F.col("x"), F.col("y"))).collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == -math.inf
    assert got[3] is None and got[4] == 0.5 and got[5] is None and math.isnan(got[6])
    assert [r[0] for r in df.select(m.safe_div(F.col("x"), F.col("y"))).collect()][:3] == [None, None, None]


def test_positive_part_keeps_null(spark):
    df = spark.createDataFrame([(3,), (-2,), (None,)], "x int")
    assert [r[0] for r in df.select(m.positive_part(F.col("x"))).collect()] == [3.0, 0.0, None]


def test_clean_missing_touches_only_floating_columns(spark):
    df = spark.createDataFrame([(float("inf"), float("nan"), 5, "NA")], "a double, b double, c int, d string")
    assert tuple(m.clean_missing(df).first()) == (None, None, 5, "NA")


def test_finite_and_missing_predicates(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),), (None,)], "x double")
    rows = df.select(m.is_missing(F.col("x")), m.is_finite(F.col("x")), m.is_infinite(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [(False, True, False), (True, False, False), (False, False, True), (True, False, False)]


def test_row_kurtosis_is_pearson(spark):
    df = spark.createDataFrame([(0, 0, 1, 0), (1, 1, 1, 1)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(rw.row_kurtosis(["a", "b", "c", "d"])).collect()]
    assert got[0] == pytest.approx(7 / 3) and got[1] is None


def test_row_statistics_propagate_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (1.0, None, 4.0)], "a double, b double, c double")
    names = ["a", "b", "c"]
    first, second = df.select(rw.row_sum(names), rw.row_mean(names), rw.row_sd(names)).collect()
    assert tuple(first) == (7.0, pytest.approx(7 / 3), pytest.approx(1.5275252316519465))
    assert tuple(second) == (None, None, None)


def test_row_missing_count_on_a_wide_frame(spark):
    wide = spark.range(1).select(*[F.lit(None if i % 3 == 0 else 1.0).cast("double").alias(f"c{i}") for i in range(750)])
    assert wide.select(rw.row_missing_count(wide)).first()[0] == 250


def test_clean_age_order_of_rules(spark):
    df = spark.createDataFrame([(-5,), (1980,), (1905,), (40,), (150,), (None,)], "age int")
    assert [r[0] for r in df.select(sc.clean_age(F.col("age"))).collect()] == [None, 41, None, 40, None, None]


def test_threshold_and_codes(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (None,)], "s double")
    assert [r[0] for r in df.select(sc.above(F.col("s"), 0.5)).collect()] == [0, 1, None]
    assert one(df, sc.round_half_even(F.lit(2.5)), sc.round_half_even(F.lit(3.5))) == (2.0, 4.0)


def test_chi_square_tail_matches_erfc():
    for x in (0.001, 0.3, 1.0, 3.84, 10.0, 99.1, 400.0):
        assert fm.chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
    assert fm.chi2_tail(4.0, 2) == pytest.approx(math.exp(-2.0), rel=1e-12)


def test_pretty_breaks():
    assert fm.pretty_breaks(1, 100, 10) == [10.0 * k for k in range(11)]
    assert fm.pretty_breaks(0.3, 0.9, 3) == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0])
    assert fm.pretty_breaks(5, 5, 4)[0] <= 5 <= fm.pretty_breaks(5, 5, 4)[-1]
