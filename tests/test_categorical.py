import pytest
from pyspark.sql import functions as F

from evenlend.operators import binning as bi, categorical as ca, columns as co
from evenlend.plans import presets as ps


def test_locale_order_puts_other_eighth():
    """With 12 occupations and 4 income bins, (last bin, "other") is cell 44 only in case-insensitive order."""
    merged = set(ps.OCCUPATIONS) - set(ps.OTHER_OCCUPATIONS["other"]) | {"other"}
    ordered = sorted(merged, key=lambda v: (v.lower(), v))
    assert len(ordered) == 12 and 36 + ordered.index("other") + 1 == 44


def test_levels_sorted_ignores_case(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("C",), (None,)], "x string")
    assert [(r["level"], r["ord"]) for r in ca.levels_sorted(df, "x").orderBy("ord").collect()] == [("a", 1), ("B", 2), ("b", 3), ("C", 4)]


def test_levels_beyond_the_driver_cap(spark, monkeypatch):
    monkeypatch.setattr(ca._ordered, "__defaults__", (5,))
    df = spark.createDataFrame([(f"v{i % 30:02d}",) for i in range(100)], "x string")
    assert [r["level"] for r in ca.levels_sorted(df, "x").orderBy("ord").collect()] == [f"v{i:02d}" for i in range(30)]
    top = ca.levels_by_freq(df, "x").orderBy("ord").collect()
    assert [r["level"] for r in top] == sorted([f"v{i:02d}" for i in range(30)], key=lambda v: (-(4 if int(v[1:]) < 10 else 3), v))


@pytest.mark.parametrize("cap,position", [(20_000, 256), (20_000, 1), (3, 256)])
def test_encoding_paths_agree(spark, monkeypatch, cap, position):
    monkeypatch.setattr(ca, "POSITION_LEVELS", position)
    df = spark.createDataFrame([(1, "b", "q"), (2, "B", "p"), (3, None, "r"), (4, "a", "s"), (5, "c", "t")], "i int, x string, y string")
    out = {r["i"]: (r["x"], r["y"]) for r in ca.encode_sorted(df, ["x", "y"], cap).collect()}
    assert out == {1: (3, 2), 2: (2, 1), 3: (None, 3), 4: (1, 4), 5: (4, 5)}


def test_relabel_with_a_missing_label(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "g int")
    assert [r["g"] for r in ca.relabel(df, "g", ["women", "men", None]).collect()] == ["women", "men", None, None]
    with pytest.raises(ValueError):
        ca.relabel(df, "g", ["women"])


def test_merge_levels_keeps_unlisted(spark):
    df = spark.createDataFrame([(27,), (28,), (3,)], "n int")
    name, levels = ps.MERGED_LEVELS["OBS_30_CNT_SOCIAL_CIRCLE"]
    assert [r["n"] for r in ca.merge_levels(df, "n", levels, name).collect()] == ["10+", "28", "3"]


def test_dummies_tie_and_missing_column(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4), ("b", 5), ("c", 6)], "x string, i int")
    out = ca.dummies(df, ["x"])
    assert out.columns == ["i", "x_b", "x_c", "x_NA"]
    assert [tuple(r) for r in out.orderBy("i").collect()][2] == (3, None, None, 1)
    assert [tuple(r) for r in ca.explicit_na(out, ["x_b"]).orderBy("i").collect()][2][1] == "0"


def test_dummies_of_awkward_labels(spark):
    labels = ["it's", "back\\slash", "ti`ck", "plain", "plain"]
    df = spark.createDataFrame([(v,) for v in labels], "`odd name` string")
    out = ca.dummies(df, ["odd name"])
    assert sorted(out.columns) == sorted(f"odd name_{v}" for v in labels[:3])
    assert sum(sum(r) for r in out.collect()) == 3


def test_integer_columns_become_labels_but_not_the_key(spark):
    df = spark.createDataFrame([(1, 2, 0.5)], "k int, n int, v double")
    assert ca.ints_to_labels(df, ["k"]).dtypes == [("k", "int"), ("n", "string"), ("v", "double")]


def test_bins_are_right_closed_and_leave_the_minimum_out(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 102)], "x double")
    rows = bi.bin_quantile(df, "x", 4).orderBy("x").collect()
    assert rows[0]["x_bin"] is None and rows[25]["x_bin"] == 1 and rows[26]["x_bin"] == 2
    included = bi.bin_quantile(df, "x", 4, include_lowest=True).orderBy("x").first()
    assert included["x_bin"] == 1 and included["x_label"].startswith("[")


def test_pretty_bins_of_ages(spark):
    df = spark.createDataFrame([(1.0,), (10.0,), (10.5,), (100.0,), (None,)], "age double")
    rows = bi.bin_pretty(df, "age", 10).collect()
    assert [r["age_label"] for r in rows] == ["[0,10]", "[0,10]", "(10,20]", "(90,100]", None]


def test_constant_and_empty_columns_have_no_bins(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    assert {tuple(r) for r in bi.bin_quantile(df, ["a", "b"], 4, labels=False).select("a_bin", "b_bin").collect()} == {(None, None)}


def test_column_selection_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "FLAG_DOCUMENT_3 int, FLAG_PHONE int, NFLAG_LAST int, X int")
    assert co.names_matching(df, ps.DOCUMENT_FLAGS) == ["FLAG_DOCUMENT_3"]
    assert co.names_matching(df, ps.CONTACT_FLAGS) == ["FLAG_PHONE", "NFLAG_LAST"]
    assert co.select_prefix(df, "FLAG_", also=["X"]).columns == ["FLAG_DOCUMENT_3", "FLAG_PHONE", "X"]
    layered = co.with_features(df, [("a", F.col("X") + 1), ("b", F.col("a") * 2), ("a", F.col("b") + 1)])
    assert tuple(layered.select("a", "b").first()) == (11, 10)


def test_binned_preset_names_59_distinct_columns():
    assert len(ps.BINNED) == len(set(ps.BINNED)) == 59
    assert len(ps.EXPLAINED_FEATURES) == len(set(ps.EXPLAINED_FEATURES)) == 34


def test_codes_are_named_by_value(spark):
    df = spark.createDataFrame([(1,), (3,), (None,), (9,)], "g int")
    assert [r["g"] for r in ca.relabel_codes(df, "g", ["one", "two", "three"]).collect()] == ["one", "three", None, None]
