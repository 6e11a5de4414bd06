from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenlend.operators import joins as jn, reweight as rw, sampling as sa


@pytest.fixture(scope="module")
def people(spark):
    """Stratum "hot" holds most rows, one row has no stratum."""
    rows = [(i, "hot" if i % 4 else "cold") for i in range(4000)] + [(4000, None)]
    return spark.createDataFrame(rows, "id long, s string")


def test_stratified_sizes_are_exact_and_ids_unique(spark, people):
    sizes = spark.createDataFrame([("hot", 1234), ("cold", 77), ("absent", 5)], "s string, size int")
    out = sa.stratified_exact(people, ["s"], sizes, "id").collect()
    assert Counter(r["s"] for r in out) == {"hot": 1234, "cold": 77}
    assert len({r["id"] for r in out}) == len(out)


@pytest.mark.parametrize("slice_rows", [sa.SLICE_ROWS, 1])
def test_stratified_equals_a_plain_ranking(spark, people, monkeypatch, slice_rows):
    monkeypatch.setattr(sa, "SLICE_ROWS", slice_rows)
    sizes = spark.createDataFrame([("hot", 500), ("cold", 100)], "s string, size int")
    score = sa.arithmetic_score(F.col("id"), 3)
    got = {r["id"] for r in sa.stratified_exact(people, ["s"], sizes, "id", score=score).collect()}
    scored = [(r["s"], r["v"], r["id"]) for r in people.select("id", "s", score.alias("v")).collect()]
    want = set()
    for s, n in (("hot", 500), ("cold", 100)):
        want |= {i for _, _, i in sorted(x for x in scored if x[0] == s)[:n]}
    assert got == want


def test_sample_is_stable_under_repartitioning_and_changes_with_the_seed(spark, people):
    sizes = spark.createDataFrame([("hot", 100)], "s string, size int")
    ids = lambda df, seed: {r["id"] for r in sa.stratified_exact(df, ["s"], sizes, "id", seed=seed).collect()}
    assert ids(people, 1) == ids(people.repartition(13), 1) != ids(people, 2)


def test_oversized_zero_and_full_requests(spark, people):
    sizes = spark.createDataFrame([("hot", 99999), ("cold", 0)], "s string, size int")
    out = sa.stratified_exact(people, ["s"], sizes, "id")
    assert out.count() == 3000 and out.select("s").distinct().count() == 1


def test_many_rows_with_one_score(spark):
    df = spark.createDataFrame([(i, "a") for i in range(500)], "id long, s string")
    sizes = spark.createDataFrame([("a", 123)], "s string, size int")
    out = sa.stratified_exact(df, ["s"], sizes, "id", score=F.lit(7).cast("long")).collect()
    assert {r["id"] for r in out} == set(range(123))


def test_rebalanced_sets(people):
    assert Counter(r["s"] for r in sa.rebalance(people, "s", "id").collect()) == {"hot": 1000, "cold": 1000}
    under = Counter(r["s"] for r in sa.undersample(people, "s", {"cold": 10}, "id").collect())
    assert under == {"cold": 10, "hot": 3000, None: 1}
    grown = sa.rebalance_collect(people, "s", "cold", "hot", 200, 300, "id").collect()
    assert Counter(r["s"] for r in grown) == {"hot": 500, "cold": 500}
    small = {r["id"] for r in sa.undersample(people, "s", {"cold": 200}, "id").filter("s = 'cold'").collect()}
    assert small <= {r["id"] for r in grown}
    assert sa.blind(people, "s").columns == ["id"]


def test_split_by_hash_is_a_partition(people):
    train, test = sa.split_by_hash(people, "id", 0.8)
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert not a & b and len(a | b) == 4001 and 0.76 < len(a) / 4001 < 0.84


def test_split_and_sample_by_lists(spark, people):
    ids = spark.createDataFrame([(5,), (6,), (6,), (99999,)], "id long")
    train, test = sa.split_by_ids(people, ids, people.select("id").subtract(ids), "id")
    assert train.count() == 2 and test.count() == 3999
    rownums = spark.createDataFrame([(1,), (3,)], "row_number long")
    picked = jn.sample_by_rownum(people.filter("id >= 100"), rownums, "id")
    assert sorted(r["id"] for r in picked.collect()) == [100, 102]


def test_augmentation_arithmetic(spark):
    """Worked numbers: ratio 1.578965 on 2,164 rows is 3416.88 up-weighted and factor 0.6333263 back to size."""
    assert 1.578965 * 2164 == pytest.approx(3416.88, abs=0.01)
    assert 2164 / (1.578965 * 2164) == pytest.approx(0.6333263, abs=1e-7)
    everyone = spark.createDataFrame([("a",)] * 60 + [("b",)] * 30 + [("c",)] * 10, "s string")
    approved = spark.createDataFrame([("a",)] * 50 + [("b",)] * 10, "s string")
    target = spark.createDataFrame([("a",)] * 25 + [("b",)] * 8 + [("c",)] * 3 + [("d",)] * 2, "s string")
    out = {r["s"]: r for r in rw.augmentation_weights(everyone, approved, target, ["s"]).collect()}
    assert out["a"]["ratio"] == pytest.approx(0.6 / (50 / 60)) and out["b"]["ratio"] == pytest.approx(0.3 / (10 / 60))
    assert out["b"]["weight"] == 8 and out["a"]["weight"] == round(25 * 0.72 / 1.8)
    assert out["c"]["ratio"] is None and out["c"]["weight"] == 3 and out["d"]["weight"] == 2


def test_reject_inference_sample_matches_weights(spark):
    rows = [(i, "xyz"[i % 3], i % 5 != 0 or i % 3 == 0) for i in range(1500)]
    everyone = spark.createDataFrame(rows, "id long, s string, ok boolean")
    approved = everyone.filter("ok")
    weights = {r["s"]: r["weight"] for r in rw.augmentation_weights(everyone, approved, everyone, ["s"]).collect()}
    sample = rw.reject_inference_sample(everyone, approved, everyone, ["s"], "id")
    check = {r["s"]: (r["n"], r["n_keys"]) for r in rw.sample_check(sample, ["s"], "id").collect()}
    assert check == {s: (w, w) for s, w in weights.items()}
