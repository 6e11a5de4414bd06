import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenlend.operators import counterfactual as cf, glm


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(11)
    n = 1500
    g = rng.choice(["w", "m"], n)
    job = rng.choice(["a", "b", "c"], n)
    age = rng.normal(size=n)
    pay = 0.6 * age + rng.normal(size=n)
    eta = -0.5 + 0.8 * (g == "m") - 0.7 * age + 0.4 * pay + 0.5 * (job == "c") + 0.6 * (g == "m") * age
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    rows = [(i, int(a), str(b), str(c), float(d), float(e)) for i, (a, b, c, d, e) in enumerate(zip(y, g, job, age, pay))]
    rows.append((n, 1, "w", "a", None, 0.0))
    return spark.createDataFrame(rows, "id long, y int, g string, job string, age double, pay double")


def matrix(loans):
    pdf = loans.dropna().toPandas()
    x = np.column_stack(
        [np.ones(len(pdf)), pdf.g == "w", pdf.job == "b", pdf.job == "c", pdf.age, pdf.pay, (pdf.g == "w") * pdf.age]
    ).astype(float)
    return x, pdf.y.to_numpy(dtype=float)


def newton(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    return b, p, np.linalg.inv(x.T @ (x * (p * (1 - p))[:, None]))


@pytest.fixture(scope="module")
def fitted(loans):
    design = glm.make_design(loans, "y", ["g", "job", "age", "pay"], interactions=[("g", "age")])
    return glm.logit_fit(loans, design)


def test_logit_matches_newton(loans, fitted):
    b, p, cov = newton(*matrix(loans))
    y = matrix(loans)[1]
    names = [glm.INTERCEPT, "g_w", "job_b", "job_c", "age", "pay", "g_w:age"]
    assert [fitted.estimates[n] for n in names] == pytest.approx(list(b), abs=1e-7)
    assert [fitted.errors[n] for n in names] == pytest.approx(list(np.sqrt(np.diag(cov))), rel=1e-5)
    assert fitted.deviance == pytest.approx(-2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), rel=1e-10)
    assert fitted.n == 1500


def test_score_equations_vanish(loans, fitted):
    assert all(abs(r["score"]) < 1e-5 for r in glm.score_equations(fitted, loans).collect())


def test_incomplete_rows_stay_without_a_score(loans, fitted):
    rows = glm.score_logit(fitted, loans).filter("id >= 1499").orderBy("id").collect()
    assert rows[0]["score"] is not None and rows[1]["score"] is None
    unseen = loans.limit(1).withColumn("job", F.lit("zzz"))
    assert glm.score_logit(fitted, unseen).first()["score"] is None


def test_aliased_columns_are_reported_not_fitted(spark, loans):
    twin = loans.withColumn("copy", F.col("age") * 3 - 1).withColumn("flat", F.lit(2.0))
    model = glm.logit_fit(twin, glm.make_design(twin, "y", ["age", "copy", "flat", "pay"]))
    assert model.aliased == ("copy", "flat")
    table = {r["term"]: r for r in glm.coefficients(spark, {"m": model}).collect()}
    assert table["copy"]["estimate"] is None and table["age"]["p_value"] < 1e-6


def test_reference_level_choice(loans):
    assert glm.make_design(loans, "y", ["job"]).levels["job"][0] == "a"
    counts = {r["job"]: r["count"] for r in loans.groupBy("job").count().collect()}
    assert glm.make_design(loans, "y", ["job"], reference="frequent").levels["job"][0] == max(counts, key=counts.get)


def test_model_without_usable_columns(loans):
    flat = loans.withColumn("flat", F.lit(1.0))
    model = glm.logit_fit(flat, glm.make_design(flat, "y", ["flat"]))
    share = flat.agg(F.avg("y")).first()[0]
    assert model.estimates[glm.INTERCEPT] == pytest.approx(math.log(share / (1 - share)))


def test_fit_statistics_and_lr_test(spark, loans, fitted):
    r2 = glm.pseudo_r2(spark, {"m": fitted}).first()
    assert r2["mcfadden"] == pytest.approx(1 - fitted.deviance / fitted.null_deviance)
    assert 0 < r2["mcfadden"] < r2["r2ml"] < r2["r2cu"] < 1
    small = glm.logit_fit(loans, glm.make_design(loans, "y", ["job", "age", "pay"]))
    test = glm.lr_test(spark, small, fitted).first()
    assert test["df"] == 2 and test["p_value"] == pytest.approx(math.exp(-test["chi2"] / 2), rel=1e-9)
    bigger = glm.logit_fit(loans, glm.make_design(loans, "y", ["job"]))
    with pytest.raises(ValueError):
        glm.lr_test(spark, bigger, fitted)


def test_generalised_vif(loans):
    model = glm.logit_fit(loans, glm.make_design(loans, "y", ["g", "job", "age", "pay"]))
    x, y = matrix(loans)
    x = x[:, :6]
    _, _, cov = newton(x, y)
    c = cov[1:, 1:]
    r = c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
    blocks = {"g": [0], "job": [1, 2], "age": [3], "pay": [4]}
    got = {row["term"]: row for row in glm.vif(model, loans).collect()}
    for term, mine in blocks.items():
        rest = [i for i in range(5) if i not in mine]
        want = np.linalg.det(r[np.ix_(mine, mine)]) * np.linalg.det(r[np.ix_(rest, rest)]) / np.linalg.det(r)
        assert got[term]["gvif"] == pytest.approx(want, rel=1e-4) and got[term]["gvif"] >= 1
        assert got[term]["tolerance"] == pytest.approx(1 / want, rel=1e-4)


def test_residuals_sum_to_the_deviance(loans, fitted):
    total = glm.residuals(fitted, loans, ["id"]).agg(F.sum(F.col("deviance_residual") ** 2)).first()[0]
    assert total == pytest.approx(fitted.deviance, rel=1e-9)


def test_screening_keeps_informative_families(loans):
    noise = loans.withColumn("noise", F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0)
    out = {r["family"]: r for r in glm.screen_features(noise, {"age": ["age", "pay"], "noise": ["noise"]}, "y").collect()}
    assert out["age"]["keep"] and not out["age"]["crosses_half"]
    assert out["noise"]["auc"] < out["age"]["auc"]


def test_counterfactual_pairs(loans, fitted):
    blind = glm.logit_fit(loans, glm.make_design(loans, "y", ["job", "age", "pay"]))
    scorers = {"aware": cf.logit_scorer(fitted), "blind": cf.logit_scorer(blind)}
    few = loans.filter("id < 50")
    rows = cf.counterfactual(few, "g", ["w", "m"], scorers).collect()
    own = {r["id"]: r["score"] for r in glm.score_logit(fitted, few).collect()}
    for r in rows:
        assert r[f"aware_{r['g']}"] == pytest.approx(own[r["id"]])
        assert r["aware_gap"] == pytest.approx(r["aware_m"] - r["aware_w"]) and r["blind_gap"] == 0.0
    long = cf.counterfactual_long(few, "g", ["w", "m"], scorers)
    assert long.count() == 100 and {"score_aware", "score_blind"} <= set(long.columns)


def test_compare_blind_rows(loans):
    rows = cf.compare_blind(loans, loans, "g", "y", ["g", "job", "age", "pay"]).collect()
    got = {(r["model"], r["metric"]): r["value"] for r in rows}
    assert got["aware", "mcfadden"] > got["blind", "mcfadden"] and got["aware_vs_blind", "lr_df"] == 1.0
    assert got["aware", "auc"] > 0.5 and got["aware", "n_pos"] + got["aware", "n_neg"] == 1500


def test_large_offsets_stay_in_the_model(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(4000):
        x = rng.gauss(0, 5)
        rows.append((int(rng.random() < 1 / (1 + math.exp(-0.2 * x))), 1e6 + x, x, 2e6 + 2 * x))
    df = spark.createDataFrame(rows, "y int, far double, near double, twice double")
    far, near = (glm.logit_fit(df, glm.make_design(df, "y", [c])) for c in ("far", "near"))
    assert not far.aliased
    assert far.estimates["far"] == pytest.approx(near.estimates["near"], rel=1e-6)
    assert far.errors["far"] == pytest.approx(near.errors["near"], rel=1e-6)
    assert glm.logit_fit(df, glm.make_design(df, "y", ["far", "twice"])).aliased == ("twice",)


def test_deviance_residual_of_an_extreme_link(spark):
    df = spark.createDataFrame([(0, 40.0), (1, 40.0), (0, 0.0)], "y int, x double")
    design = glm.make_design(df, "y", ["x"])
    model = glm.LogitModel(design, {glm.INTERCEPT: 0.0, "x": 1.0}, {}, 0.0, 0.0, 0.0, 3)
    got = [r["deviance_residual"] for r in glm.residuals(model, df, []).collect()]
    assert got == pytest.approx([-math.sqrt(80), 0.0, -math.sqrt(2 * math.log(2))], abs=1e-6)


def test_influence_measures(loans, fitted):
    x, y = matrix(loans)
    _, p, cov = newton(x, y)
    h = p * (1 - p) * np.einsum("ij,jk,ik->i", x, cov, x)
    r = (y - p) / np.sqrt(p * (1 - p))
    d = np.sign(y - p) * np.sqrt(-2 * np.where(y == 1, np.log(p), np.log(1 - p)))
    got = glm.influence(fitted, loans, ["id"]).toPandas().sort_values("id")
    assert len(got) == 1500
    assert got["leverage"].to_numpy() == pytest.approx(h, rel=1e-6) and h.sum() == pytest.approx(7)
    assert got["std_deviance"].to_numpy() == pytest.approx(d / np.sqrt(1 - h), rel=1e-6)
    assert got["std_pearson"].to_numpy() == pytest.approx(r / np.sqrt(1 - h), rel=1e-6)
    assert got["cook"].to_numpy() == pytest.approx((r / (1 - h)) ** 2 * h / 7, rel=1e-6)
    ranks = got["std_deviance"].rank().to_numpy()
    assert got["position"].to_numpy() == pytest.approx((ranks - 0.5) / 1500)
    from statistics import NormalDist

    assert got["normal_quantile"].to_numpy() == pytest.approx([NormalDist().inv_cdf(v) for v in got["position"]], abs=1e-9)


def test_equal_rows_are_fitted_once(spark, loans, fitted, monkeypatch):
    """Repeated rows give the fit of the weighted table, from as many rows as differ."""
    many = loans.crossJoin(spark.range(40).select(F.col("id").alias("copy"))).drop("copy")
    held, real = [], glm.counted_rows
    monkeypatch.setattr(glm, "counted_rows", lambda rows: held.append(real(rows)) or held[-1])
    model = glm.logit_fit(many, fitted.design)
    assert held[0].count() == 1500 and model.n == 40 * fitted.n
    assert model.deviance == pytest.approx(40 * fitted.deviance, rel=1e-9)
    for term, b in fitted.estimates.items():
        assert model.estimates[term] == pytest.approx(b, abs=1e-7)
        assert model.errors[term] * math.sqrt(40) == pytest.approx(fitted.errors[term], rel=1e-6)
    assert glm.logit_fit(loans, fitted.design).n == fitted.n and held[1].count() == 1500


def test_influence_without_positions_shuffles_nothing(loans, fitted):
    whole = glm.influence(fitted, loans, ["id"])
    plain = glm.influence(fitted, loans, ["id"], positions=False)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    key = lambda rows: sorted(tuple(round(v, 9) for v in r) for r in rows)
    assert key(plain.drop("y").collect()) == key(whole.drop("y", "position", "normal_quantile").collect())


def test_few_patterns_of_many_rows(spark):
    """Heavy weights on rows that differ in the label only; the fit is the plain one."""
    rng = np.random.default_rng(5)
    x = rng.integers(1, 51, 40_000) / 50
    y = (rng.random(40_000) < 0.25).astype(float)
    df = spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "y double, a double")
    many = df.crossJoin(spark.range(50)).select("y", "a")
    model = glm.logit_fit(many, glm.make_design(many, "y", ["a"]))
    b, p, _ = newton(np.column_stack([np.ones(len(x)), x]), y)
    assert [model.estimates[t] for t in ("(Intercept)", "a")] == pytest.approx(list(b), abs=1e-8)
    assert model.n == 2_000_000
