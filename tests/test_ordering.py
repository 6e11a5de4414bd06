import numpy as np
import pytest
from pyspark.sql import functions as F

from evenlend.operators import aggregate as ag, ordering as od


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold a third of the rows; one group is missing."""
    rng = np.random.default_rng(3)
    groups = rng.choice(["a", "b", "c", None], size=3000, p=[0.4, 0.3, 0.2, 0.1])
    values = np.where(rng.random(3000) < 0.33, 7.0, rng.normal(size=3000).round(2))
    rows = [(i, None if g is None else str(g), float(v)) for i, (g, v) in enumerate(zip(groups, values))]
    rows += [(3000, "a", None), (3001, "b", float("nan"))]
    return spark.createDataFrame(rows, "id long, g string, v double"), rows


def test_row_number_is_global_and_exact(skewed):
    df, rows = skewed
    out = od.with_row_number(df.select("id"), "id").collect()
    assert {r["id"]: r["row_number"] for r in out} == {i: i + 1 for i in range(len(rows))}


def test_row_number_in_groups_with_a_null_group(skewed):
    df, rows = skewed
    out = od.with_row_number(df.select("id", "g"), "id", groups=["g"]).collect()
    seen = {}
    for r in sorted(out, key=lambda r: r["id"]):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["row_number"] == seen[r["g"]]
    assert len(out) == len(rows)


@pytest.mark.parametrize("chunks,rows_in_window", [(20_000, 4_000_000), (20_000, 1), (3, 4_000_000)])
def test_quantiles_match_numpy(skewed, monkeypatch, chunks, rows_in_window):
    monkeypatch.setattr(od, "WANTED_CHUNKS", chunks)
    monkeypatch.setattr(od, "WINDOW_ROWS", rows_in_window)
    df, rows = skewed
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for row in od.exact_quantiles(df, ["v"], probs, ["g"]).collect():
        mine = [v for _, g, v in rows if g == row["g"] and v is not None and v == v]
        assert row["n"] == len(mine)
        assert row["quantiles"] == pytest.approx(list(np.quantile(mine, probs)))


def test_quantiles_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    rows = od.exact_quantiles(df, ["a", "b"], [0.25, 0.5]).collect()
    assert [(r["column"], r["quantiles"]) for r in rows] == [("a", [1.0, 1.0])]


def test_running_totals_match_a_plain_cumulative_sum(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 5).alias("w"))
    out = od.running_totals(df, "k", {"cum": F.col("w")}).orderBy("k").collect()
    assert [r["cum"] for r in out] == list(np.cumsum([r["w"] for r in out]))


def test_position_by_strings(spark):
    words = [f"{chr(97 + i % 26)}{'X' if i % 2 else 'x'}{i}" for i in range(900)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    out = od.position_by(df, F.struct(F.lower("w").alias("l"), F.col("w").alias("e")), "pos", buckets=37).collect()
    assert [r["w"] for r in sorted(out, key=lambda r: r["pos"])] == sorted(words, key=lambda w: (w.lower(), w))
    assert sorted(r["pos"] for r in out) == list(range(1, 901))


def test_no_window_runs_over_all_rows_in_one_partition(skewed):
    df, _ = skewed
    plan = od.with_row_number(df.select("id", "g"), "id")._jdf.queryExecution().executedPlan().toString()
    windows = plan.count("SinglePartition")
    assert windows <= 1  # only the one-row-per-bucket offsets
    assert "__chunk" in plan


def test_group_median_missing_rules(skewed):
    df, rows = skewed
    strict = {r["g"]: r["median"] for r in ag.group_median(df.filter("id <> 3001"), "g", "v").collect()}
    assert strict["a"] is None and strict["b"] is not None and None in strict
    loose = {r["g"]: r["median"] for r in ag.group_median(df, "g", "v", na_rm=True).collect()}
    for g in ("a", "b", "c", None):
        assert loose[g] == pytest.approx(np.median([v for _, k, v in rows if k == g and v is not None and v == v]))


def test_top_k_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 5.0), ("d", 1.0)], "f string, v double")
    assert [r["f"] for r in od.top_k(df, "v", 3, ["f"]).collect()] == ["c", "a", "b"]
