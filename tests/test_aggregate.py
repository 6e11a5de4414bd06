import math

import pytest
from pyspark.sql import functions as F

from evenlend.functions import missing as m
from evenlend.operators import aggregate as ag, categorical as ct, frequency as fr, joins as jn
from evenlend.operators.glm import make_design

EDGE = [(1, 1.0, 0.0), (1, 0.0, 0.0), (2, None, 5.0), (3, 7.0, 1.0), (4, -3.0, 2.0), (4, 3.0, 2.0), (4, 3.0, 2.0)]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "g int, x double, y double")
    return df.withColumn("r", m.ieee_div(F.col("x"), F.col("y")))


def by_key(df, key="g"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("group_cells", [1_000_000, 1])
def test_six_statistics_on_edge_groups(edge, group_cells):
    out = by_key(ag.summarise_all(edge, "g", group_cells=group_cells))
    assert out[1]["r_mean"] == math.inf and out[1]["r_max"] == math.inf and out[1]["r_n_distinct"] == 1
    assert out[2]["x_sum"] == 0.0 and out[2]["x_n_distinct"] == 0 and out[2]["x_mean"] is None and out[2]["x_min"] is None
    assert out[3]["x_sd"] is None and out[3]["x_mean"] == 7.0
    assert (out[4]["x_n_distinct"], out[4]["x_sum"], out[4]["x_min"], out[4]["x_max"]) == (2, 3.0, -3.0, 3.0)
    cleaned = by_key(m.clean_missing(ag.summarise_all(edge, "g", group_cells=group_cells)))
    assert cleaned[1]["r_mean"] is None and cleaned[1]["r_sd"] is None


def test_hot_and_cold_groups_agree_including_a_null_key(spark):
    rows = [(None if i % 3 == 0 else i % 40 + 1, float(i % 17), i % 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, x double, c int")
    plain = by_key(ag.summarise_all(df, "g"))
    mixed = by_key(ag.summarise_all(df, "g", group_cells=200))  # the NULL key and no other is hot
    assert set(plain) == set(mixed) and None in mixed
    for g, row in plain.items():
        assert mixed[g] == pytest.approx(row)


def test_negative_zero_is_one_value(spark):
    df = spark.createDataFrame([(1, 0.0), (1, -0.0)], "g int, x double")
    for cells in (1_000_000, 1):
        assert ag.summarise_all(df, "g", group_cells=cells).first()["x_n_distinct"] == 1


def test_too_many_hot_keys_still_give_whole_results(spark, monkeypatch):
    monkeypatch.setattr(ag.hot_keys, "__defaults__", (2,))
    df = spark.createDataFrame([(i % 10, float(i)) for i in range(100)], "g int, x double")
    out = by_key(ag.summarise_all(df, "g", group_cells=1))
    assert len(out) == 10 and all(r["x_n_distinct"] == 10 for r in out.values())


def test_nested_summary_keeps_children_without_grandchildren(spark):
    grand = spark.createDataFrame([(10, "b", 1.0), (10, "a", 3.0)], "loan int, status string, v double")
    child = spark.createDataFrame([(1, 10, "x"), (1, 11, "y")], "person int, loan int, kind string")
    row = ag.summarise_nested(grand, child, "loan", "person").first().asDict()
    assert row["v_mean_mean"] == 2.0 and row["v_mean_n_distinct"] == 1 and row["status_max_max"] == 2.0
    assert row["kind_n_distinct"] == 2 and row["v_sum_sum"] == 4.0 and "loan_mean" not in row


def test_infinite_extremes_of_empty_groups(spark):
    df = spark.createDataFrame([(1, None)], "g int, x double")
    row = ag.summarise_all(df, "g", infinite_empty=True).first()
    assert (row["x_min"], row["x_max"]) == (math.inf, -math.inf)


def test_profile_and_null_counts(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, "a"), (float("nan"), "b")], "x double, s string")
    row = ag.profile(df, ["x"]).first()
    assert (row["n"], row["n_missing"], row["min"], row["median"], row["max"]) == (2, 2, 1.0, 1.5, 2.0)
    assert {r["column"]: r["n_missing"] for r in ag.null_counts(df).collect()} == {"x": 2, "s": 1}


def test_star_join_suffixes(spark):
    base = spark.createDataFrame([(1,)], "k int")
    side = spark.createDataFrame([(1, 5)], "k int, n int")
    out = jn.star_join(base, {"a": side, "b": side, "c": side}, "k", ("_x", "_y"))
    assert out.columns == ["k", "n_x", "n_y", "n"]
    assert jn.star_join(base, {"a": side, "b": side}, "k").columns == ["k", "a__n", "b__n"]


def test_salted_and_broadcast_lookups_agree(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i % 7}") for i in range(300)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k6", 3)], "k string, v int")
    small = jn.lookup_join(df, table, "k").select("i", "k", "v").collect()
    salted = jn.lookup_join(df, table, "k", max_rows=1).select("i", "k", "v").collect()
    assert sorted(small, key=str) == sorted(salted, key=str) and len(small) == 300


def test_recode_keeps_unmatched_and_trailing_blanks(spark):
    df = spark.createDataFrame([("cook ",), ("cook",), (None,)], "job string")
    mapping = spark.createDataFrame([("cook ", "Cooking staff")], "old string, new string")
    assert [r["job"] for r in jn.recode_by_table(df, "job", mapping, "old", "new").collect()] == ["Cooking staff", "cook", None]


def test_contingency_sums_to_one_and_keeps_zero_cells(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("b", 2, None)], "p string, q int, r string")
    rows = fr.contingency(df, ["p", "q", "r"], normalize=True).collect()
    assert len(rows) == 4 and sum(r["n"] for r in rows) == 2 and sum(r["prop"] for r in rows) == pytest.approx(1.0)
    grid = fr.level_grid(df, {"p": [str(i) for i in range(2000)], "q": range(1500)})
    assert grid.count() == 3_000_000 and grid.dropDuplicates().count() == 3_000_000


def test_levels_beyond_the_driver_list(spark):
    df = spark.range(25_000).selectExpr("concat('v', id) AS p", "int(id % 2) AS q", "double(id % 3) AS y")
    table = fr.contingency(df, ["p", "q"])
    assert table.count() == 50_000
    assert table.agg(F.sum("n")).first()[0] == 25_000
    ones = ct.dummies_long(df.withColumn("k", F.monotonically_increasing_id()), ["k"], ["p", "q"])
    assert ones.filter("column = 'p'").count() == 24_999 and ones.filter("column = 'q'").count() == 12_500
    assert len(make_design(df, "y", ["p"]).columns()) == 24_999


def test_ratio_of_groups_aligns_by_key(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "k string, prop double")
    b = spark.createDataFrame([("y", 0.25), ("z", 0.75)], "k string, prop double")
    out = {r["k"]: r["ratio"] for r in jn.ratio_of_groups(a, b, ["k"], "prop").collect()}
    assert out == {"x": None, "y": 2.0, "z": 0.0}


def test_hot_keys_are_salted_by_their_count(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 20 END AS k")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(15)], "k long, v string")
    want = sorted(df.join(table, ["k"], "left").collect(), key=repr)
    for hot in (1, 40, 10_000):
        assert sorted(jn.salted_join(df, table, ["k"], "left", hot_rows=hot).collect(), key=repr) == want


def test_counted_digits_only_touch_the_count(spark):
    df = spark.createDataFrame([(1, 0.1 + 0.2), (1, 0.3), (1, 3e-11), (1, 0.0), (1, float("inf"))], "g int, x_mean double")
    got = ag.summarise_all(df, "g", ["min", "max", "n_distinct"], counted_digits=12).first()
    assert (got["x_mean_n_distinct"], got["x_mean_min"], got["x_mean_max"]) == (4, 0.0, float("inf"))
    assert ag.summarise_all(df, "g", ["n_distinct"]).first()["x_mean_n_distinct"] == 5


def test_label_profile(spark):
    rows = [("a", None)] * 5 + [("b", "x")] * 5 + [("c", "x")] * 2 + [(None, "y")] * 3 + [("d", "z")]
    got = ag.label_profile(spark.createDataFrame(rows, "p string, q string"), ["p", "q"], top=3)
    found = {(r["column"], r["place"]): (r["level"], r["n"]) for r in got.collect()}
    assert found == {
        ("p", 1): ("a", 5), ("p", 2): ("b", 5), ("p", 3): ("(Missing)", 3), ("p", 4): ("(Other)", 3),
        ("q", 1): ("x", 7), ("q", 2): ("(Missing)", 5), ("q", 3): ("y", 3), ("q", 4): ("(Other)", 1),
    }
    assert ag.label_profile(spark.createDataFrame([], "p string"), ["p"]).count() == 0
