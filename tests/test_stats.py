import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenlend.operators import metrics as me, stats as st

# Known two-proportion results: (cell, x1, x2, X-squared, p), denominators below.
GENDER_TOTALS = (56275, 52153)
ALL_TOTALS = (58626, 54452)
GOLDEN_GENDER = [
    ("women, no default", 21070, 19352, 1.28433, 0.2571),
    ("women, default", 577, 572, 1.25074, 0.2634),
    ("men, no default", 31502, 29137, 0.12932, 0.7191),
    ("men, default", 3126, 3092, 6.92905, 0.008481),
]
GOLDEN_ALL = [
    ("separated, no default", 682, 681, 1.73568, 0.1877),
    ("unknown, no default", 6360, 5507, 16.15531, 5.835e-05),
    ("separated", 747, 746, 1.91719, 0.1662),
    ("unknown", 8901, 8030, 4.1764, 0.04099),
    ("civil marriage", 626, 559, 0.4231, 0.5154),
    ("married", 33108, 30834, 0.26201, 0.6087),
    ("single", 14126, 13220, 0.50656, 0.4766),
    ("widow", 1118, 1063, 0.28116, 0.5959),
    ("core staff", 31135, 29452, 10.86546, 0.0009797),
    ("managers", 5109, 4526, 5.82061, 0.01584),
    ("age 0-10", 33, 32, 0.00246, 0.9605),
    ("age 10-20", 147, 145, 0.20803, 0.6483),
    ("age 20-30", 1166, 1145, 1.7727, 0.183),
    ("age 30-40", 11039, 10250, 0.00027, 0.9868),
    ("age 40-50", 16796, 15372, 2.4148, 0.1202),
    ("age 50-60", 13906, 12830, 0.38077, 0.5372),
    ("age 60-70", 7238, 6634, 0.68059, 0.4094),
    ("age 70-80", 1537, 1424, 0.00254, 0.9598),
    ("age 80-90", 188, 182, 0.12035, 0.7287),
    ("age 90-100", 16, 16, 0.00103, 0.9744),
    ("income 1", 13542, 11242, 99.13785, 2.355e-23),
    ("income 2", 15233, 14770, 18.81118, 1.443e-05),
]


def test_known_proportion_tests(spark):
    rows = [(c, x1, GENDER_TOTALS[0], x2, GENDER_TOTALS[1]) for c, x1, x2, _, _ in GOLDEN_GENDER]
    rows += [(c, x1, ALL_TOTALS[0], x2, ALL_TOTALS[1]) for c, x1, x2, _, _ in GOLDEN_ALL]
    cells = spark.createDataFrame(rows, "cell string, x1 long, n1 long, x2 long, n2 long")
    got = {r["cell"]: r for r in st.prop_test(cells).collect()}
    for cell, _, _, stat, p in GOLDEN_GENDER + GOLDEN_ALL:
        assert got[cell]["statistic"] == pytest.approx(stat, abs=6e-6)
        assert got[cell]["p_value"] == pytest.approx(p, rel=6e-4)


def test_cells_missing_on_one_side(spark):
    a = spark.createDataFrame([("x",)] * 6 + [("y",)] * 4 + [(None,)] * 2, "s string")
    b = spark.createDataFrame([("x",)] * 5 + [(None,)] * 2, "s string")
    out = {r["s"]: r for r in st.prop_test_by(a, b, ["s"]).collect()}
    assert (out["y"]["x1"], out["y"]["x2"], out["y"]["n1"], out["y"]["n2"]) == (4, 0, 12, 7)
    assert (out[None]["x1"], out[None]["x2"]) == (2, 2) and len(out) == 3


def test_kolmogorov_smirnov_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400).round(1), (rng.normal(size=300) + 0.2).round(1)
    frames = [spark.createDataFrame([(float(v),) for v in s] + [(None,)], "v double") for s in (a, b)]
    row = st.ks_2samp(*frames, "v").first()
    grid = np.unique(np.concatenate([a, b]))
    d = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    z = d * math.sqrt(400 * 300 / 700)
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 100))
    assert row["d"] == pytest.approx(d) and row["p_value"] == pytest.approx(p)
    assert (row["n1"], row["n2"]) == (400, 300)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    y = (rng.random(600) < 0.3).astype(int)
    s = (rng.normal(size=600) + y * 0.7).round(1)
    g = rng.integers(0, 2, 600)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, s, g)] + [(1, None, 0)], "y int, s double, g int")
    return df, y, s, g


def placements(y, s):
    pos, neg = s[y == 1], s[y == 0]
    kernel = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
    v10, v01 = kernel.mean(axis=1), kernel.mean(axis=0)
    return kernel.mean(), math.sqrt(v10.var(ddof=1) / len(pos) + v01.var(ddof=1) / len(neg))


def test_auc_and_delong_against_all_pairs(scored):
    df, y, s, _ = scored
    row = me.auc_ci(df, "y", "s").first()
    area, se = placements(y, s)
    assert row["auc"] == pytest.approx(area, abs=1e-12) and row["se"] == pytest.approx(se, rel=1e-9)
    assert row["upper"] - row["lower"] == pytest.approx(2 * 1.959963984540054 * se)


def test_auc_by_group(scored):
    df, y, s, g = scored
    out = {r["g"]: r for r in me.auc_ci(df, "y", "s", groups=["g"]).collect()}
    for k in (0, 1):
        area, se = placements(y[g == k], s[g == k])
        assert out[k]["auc"] == pytest.approx(area, abs=1e-12) and out[k]["se"] == pytest.approx(se, rel=1e-9)


def test_auc_of_negated_score_and_automatic_direction(scored):
    df, *_ = scored
    flipped = df.withColumn("s", -F.col("s"))
    area = me.auc(df, "y", "s").first()["auc"]
    assert me.auc(flipped, "y", "s").first()["auc"] == pytest.approx(1 - area)
    assert me.auc(flipped, "y", "s", direction="auto").first()["auc"] == pytest.approx(area)


def test_confusion_measures(scored):
    df, y, s, _ = scored
    row = me.confusion(df, "y", "s").first()
    hat = (s > s.mean()).astype(int)
    tp, fp = int(((hat == 1) & (y == 1)).sum()), int(((hat == 1) & (y == 0)).sum())
    fn, tn = int(((hat == 0) & (y == 1)).sum()), int(((hat == 0) & (y == 0)).sum())
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (tp, fp, fn, tn)
    po, n = (tp + tn) / 600, 600
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / n**2
    assert row["kappa"] == pytest.approx((po - pe) / (1 - pe))
    assert row["mcnemar"] == pytest.approx((abs(fp - fn) - 1) ** 2 / (fp + fn))
    assert row["balanced_accuracy"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)


def test_confusion_with_one_class_predicted(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.2)], "y int, s double")
    row = me.confusion(df, "y", "s").first()
    assert (row["tp"], row["tn"]) == (0, 1) and row["ppv"] is None


def test_exact_interval_and_tests_of_the_confusion(scored):
    df, y, s, _ = scored
    row = me.confusion(df, "y", "s").first()
    n, k = 600, row["tp"] + row["tn"]
    tail = lambda p, k: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert tail(row["accuracy_lower"], k) == pytest.approx(0.025, rel=1e-6)
    assert 1 - tail(row["accuracy_upper"], k + 1) == pytest.approx(0.025, rel=1e-6)
    assert row["no_information"] == pytest.approx(max(y.mean(), 1 - y.mean()))
    assert row["no_information_p"] == pytest.approx(tail(row["no_information"], k), rel=1e-6)
    assert row["mcnemar_p"] == pytest.approx(math.erfc(math.sqrt(row["mcnemar"] / 2)))


def test_incomplete_beta_ends():
    from evenlend.functions import formulas as fo

    assert fo.beta_cdf(0.0, 2, 3) == 0.0 and fo.beta_cdf(1.0, 2, 3) == 1.0
    assert fo.beta_cdf(0.3, 1, 1) == pytest.approx(0.3) and fo.beta_cdf(0.2, 2, 1) == pytest.approx(0.04)
    assert fo.beta_quantile(0.25, 2, 1) == pytest.approx(0.5)
    assert fo.beta_cdf(0.5, 500_000, 500_000) == pytest.approx(0.5, abs=1e-9)


@pytest.mark.parametrize("a, b", [([1, 2, 3], [4, 5, 6, 7]), ([1, 1, 2], [1, 2, 2, 3]), ([0.5, 3], [1, 2, 3, 3, 4]), ([1], [1]), ([5, 1, 4, 2], [3, 3, 3])])
def test_exact_distance_p_equals_enumeration(spark, a, b):
    import itertools

    pool = sorted(a + b)

    def distance(first):
        rest = list(range(len(pool)))
        for i in first:
            rest.remove(i)
        x, y = [pool[i] for i in first], [pool[i] for i in rest]
        return max(abs(sum(v <= t for v in x) * len(y) - sum(v <= t for v in y) * len(x)) for t in pool)

    seen = max(abs(sum(v <= t for v in a) * len(b) - sum(v <= t for v in b) * len(a)) for t in pool)
    all_ = [distance(c) >= seen for c in itertools.combinations(range(len(pool)), len(a))]
    frames = [spark.createDataFrame([(float(v),) for v in x], "v double") for x in (a, b)]
    assert st.ks_2samp(*frames, "v").first()["p_value"] == pytest.approx(sum(all_) / len(all_))


def test_paired_areas(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 300)
    a, b = np.round(y + rng.normal(size=300), 1), np.round(0.5 * y + rng.normal(size=300), 1)
    rows = [(int(i), float(u), float(v)) for i, u, v in zip(y, a, b)] + [(None, 1.0, 1.0), (1, None, 0.0), (0, 1.0, float("nan"))]
    got = me.auc_paired(spark.createDataFrame(rows, "y int, a double, b double"), "y", "a", "b").first()

    def parts(s):
        p, q = s[y == 1], s[y == 0]
        k = (p[:, None] > q) + (p[:, None] == q) / 2
        return k.mean(axis=1), k.mean(axis=0)

    (ap, aq), (bp, bq) = parts(a), parts(b)
    var = np.var(ap - bp, ddof=1) / len(ap) + np.var(aq - bq, ddof=1) / len(aq)
    assert (got["n_pos"], got["n_neg"]) == (len(ap), len(aq))
    assert got["auc_a"] == pytest.approx(ap.mean()) and got["difference"] == pytest.approx(ap.mean() - bp.mean())
    assert got["se"] == pytest.approx(math.sqrt(var)) and got["p_value"] == pytest.approx(math.erfc(abs(got["z"]) / math.sqrt(2)))
    alone = me.auc_paired(spark.createDataFrame([(1, 1.0, 2.0)], "y int, a double, b double"), "y", "a", "b").first()
    assert alone["n_neg"] == 0 and alone["se"] is None


def test_bootstrap_interval(scored):
    df, *_ = scored
    drawn = me.auc_bootstrap(df, "y", "s", 1000).first()
    again = me.auc_bootstrap(df.repartition(3), "y", "s", 1000).first()
    closed = me.auc_ci(df, "y", "s").first()
    assert drawn == again and drawn["auc"] == pytest.approx(closed["auc"])
    for end in ("lower", "upper"):
        assert abs(drawn[end] - closed[end]) < closed["se"] / 3
    assert me.auc_bootstrap(df, "y", "s", 1000, seed=5).first()["lower"] != drawn["lower"]
    flipped = me.auc_bootstrap(df.withColumn("s", -F.col("s")), "y", "s", 1000, direction="auto").first()
    assert flipped["auc"] == pytest.approx(closed["auc"])
