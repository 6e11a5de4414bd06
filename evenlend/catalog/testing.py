"""Two-population tests, ranking metrics and threshold metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as me, stats as st
from .registry import load, query, tidy


def erfc_sql(z: str, steps: int = 400) -> str:
    """erfc by Simpson's rule over [0, z]."""
    h = f"(({z}) / {steps})"
    return (
        f"greatest(0::DOUBLE, 1 - 2 / sqrt(pi()) * {h} / 3 * list_sum(["
        f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(i * {h}, 2)) "
        f"FOR i IN range(0, {steps + 1})]))"
    )


def exact_sql(counts: str, name: str = "exact") -> str:
    """CTEs ``<name>`` (model, lower, upper, no_information_p) for rows ``model, k, n, nir``: halving on sums of binomial terms."""
    tail = "list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})) FOR i IN range({k}, n + 1)])"
    return f"""{name}_c AS MATERIALIZED (SELECT model, k::BIGINT AS k, n::BIGINT AS n, nir FROM ({counts})),
    {name}_b AS (
      SELECT model, n, 0 AS step, k + side AS k, CASE side WHEN 0 THEN 0.025 ELSE 0.975 END::DOUBLE AS target, side, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
      FROM {name}_c, (SELECT unnest([0, 1]) AS side)
      UNION ALL
      SELECT model, n, step + 1, k, target, side, CASE WHEN t < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN t < target THEN hi ELSE (lo + hi) / 2 END
      FROM (SELECT *, {tail.format(p='((lo + hi) / 2)', k='k')} AS t FROM {name}_b WHERE step < 45)),
    {name} AS (
      SELECT model, max(lo) FILTER (WHERE side = 0) AS lower, max(lo) FILTER (WHERE side = 1) AS upper, any_value(p) AS no_information_p
      FROM {name}_b JOIN (SELECT model, {tail.format(p='nir', k='k')} AS p FROM {name}_c) USING (model) WHERE step = 45 GROUP BY model)"""


def measures_sql(scored: str) -> str:
    """CTEs ending in ``measures`` (model, metric, value): everything that ranking and threshold say about rows ``model, y, s``."""
    shares = "(tp + tn) / n, (po - pe) / (1 - pe), se_, sp_, tp / (tp + fp), tn / (tn + fn), (tp + fn) / n, tp / n, (tp + fp) / n, (se_ + sp_) / 2"
    named = "accuracy kappa sensitivity specificity ppv npv prevalence detection_rate detection_prevalence balanced_accuracy".split()
    chi = "greatest(abs(fp - fn) - 1, 0) ** 2 / (fp + fn)"
    return f"""scored AS MATERIALIZED ({scored}),
    steps AS (SELECT model, s, sum(y)::DOUBLE AS p, (count(*) - sum(y))::DOUBLE AS q FROM scored GROUP BY ALL),
    runs AS (SELECT model, p, q, coalesce(sum(q) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                    coalesce(sum(p) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
                    sum(p) OVER (PARTITION BY model) AS np, sum(q) OVER (PARTITION BY model) AS nq FROM steps),
    places AS (SELECT model, p, q, np, nq, (below + q / 2) / nq AS v10, (above + p / 2) / np AS v01 FROM runs),
    area AS (SELECT model, max(np) AS np, max(nq) AS nq, sum(p * v10) / max(np) AS auc FROM places GROUP BY model),
    spread AS (SELECT area.model, any_value(area.np) AS np, any_value(area.nq) AS nq, any_value(auc) AS auc,
                 sqrt(sum(p * (v10 - auc) ** 2) / (any_value(area.np) - 1) / any_value(area.np) + sum(q * (v01 - auc) ** 2) / (any_value(area.nq) - 1) / any_value(area.nq)) AS se
               FROM places JOIN area ON area.model = places.model GROUP BY area.model),
    cuts_ AS (SELECT model, avg(s) AS cut FROM scored GROUP BY model),
    hits AS (SELECT scored.model, count(*) FILTER (WHERE s > cut AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE s > cut AND y = 0)::DOUBLE AS fp,
                 count(*) FILTER (WHERE s <= cut AND y = 1)::DOUBLE AS fn, count(*) FILTER (WHERE s <= cut AND y = 0)::DOUBLE AS tn
             FROM scored JOIN cuts_ ON cuts_.model = scored.model GROUP BY scored.model),
    rates AS (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) ** 2) AS pe,
                 tp / (tp + fn) AS se_, tn / (tn + fp) AS sp_, greatest(tp + fn, fp + tn) / (tp + fp + fn + tn) AS nir, {chi} AS chi FROM hits),
    {exact_sql('SELECT model, tp + tn AS k, n, nir FROM rates')},
    measures AS (
      SELECT model, unnest(['n_pos', 'n_neg', 'auc', 'se', 'lower', 'upper']) AS metric,
             unnest([np, nq, auc, se, greatest(0, auc - 1.959963984540054 * se), least(1, auc + 1.959963984540054 * se)]) AS value FROM spread
      UNION ALL SELECT model, unnest(['tp', 'fp', 'fn', 'tn', {', '.join(f"'{n}'" for n in named)}, 'mcnemar', 'no_information']), unnest([tp, fp, fn, tn, {shares}, chi, nir]) FROM rates
      UNION ALL SELECT model, 'mcnemar_p', {erfc_sql('sqrt(chi / 2)')} FROM rates
      UNION ALL SELECT model, unnest(['accuracy_lower', 'accuracy_upper', 'no_information_p']), unnest([lower, upper, no_information_p]) FROM exact)"""


def pick_sql(metric: str) -> str:
    return f"max(value) FILTER (WHERE metric = '{metric}')"


@query(
    "prop_test_by",
    f"""
    WITH t AS (SELECT o_orderstatus AS s, o_orderpriority AS priority, cast(floor(o_totalprice / 50000) AS BIGINT) AS band FROM orders),
    c AS (SELECT priority, band, count(*) AS x1, count(*) FILTER (WHERE s <> 'P') AS x2 FROM t GROUP BY ALL),
    n AS (SELECT c.*, (SELECT count(*) FROM t) AS n1, (SELECT count(*) FROM t WHERE s <> 'P') AS n2 FROM c),
    p AS (SELECT *, x1 / n1::DOUBLE AS p1, x2 / n2::DOUBLE AS p2, (x1 + x2) / (n1 + n2)::DOUBLE AS p FROM n),
    y AS (SELECT *, least(0.5, abs(p1 - p2) / (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS y FROM p),
    k AS (SELECT *, (abs(x1 - n1 * p) - y) ** 2 / (n1 * p) + (abs((n1 - x1) - n1 * (1 - p)) - y) ** 2 / (n1 * (1 - p))
                  + (abs(x2 - n2 * p) - y) ** 2 / (n2 * p) + (abs((n2 - x2) - n2 * (1 - p)) - y) ** 2 / (n2 * (1 - p)) AS x FROM y)
    SELECT priority, band, x1, x2, n1, n2, round(p1, 9) AS p1, round(p2, 9) AS p2, round(x, 6) AS statistic,
           round({erfc_sql('sqrt(x / 2)')}, 6) AS p_value
    FROM k
    """,
)
def prop_test_by(spark, sf_dir):
    """Every cell's share in two populations, with continuity correction."""
    (orders,) = load(spark, sf_dir, "orders")
    everyone = orders.select(
        "o_orderstatus", F.col("o_orderpriority").alias("priority"), F.floor(F.col("o_totalprice") / 50000).alias("band")
    )
    out = st.prop_test_by(everyone, everyone.filter("o_orderstatus <> 'P'"), ["priority", "band"])
    return out.select(
        "priority", "band", "x1", "x2", "n1", "n2", F.round("p1", 9).alias("p1"), F.round("p2", 9).alias("p2"),
        F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"),
    )


@query(
    "ks_two_sample",
    """
    WITH v AS (SELECT o_totalprice AS v, count(*) FILTER (WHERE o_orderstatus = 'P') AS a, count(*) FILTER (WHERE o_orderstatus <> 'P') AS b FROM orders GROUP BY ALL),
    c AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM v),
    d AS (SELECT cast(max(n1) AS BIGINT) AS n1, cast(max(n2) AS BIGINT) AS n2, max(abs(ca / n1::DOUBLE - cb / n2::DOUBLE)) AS d FROM c)
    SELECT n1, n2, round(d, 9) AS d,
           round(least(1, greatest(0, 2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
             * exp(greatest(-700, -2.0::DOUBLE * k * k * d * d * (n1 * n2 / (n1 + n2)::DOUBLE))) FOR k IN range(1, 2001)]))), 6) AS p_value
    FROM d
    """,
)
def ks_two_sample(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    out = st.ks_2samp(orders.filter("o_orderstatus = 'P'"), orders.filter("o_orderstatus <> 'P'"), "o_totalprice")
    return out.select("n1", "n2", F.round("d", 9).alias("d"), F.round("p_value", 6).alias("p_value"))


def _scored(spark, sf_dir):
    (lines,) = load(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("s"), F.col("l_quantity").alias("q"))


STEPS = """
    v AS (SELECT {s} AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) FILTER (WHERE l_returnflag <> 'R') AS q FROM lineitem GROUP BY ALL),
    c AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                 coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
                 sum(p) OVER () AS np, sum(q) OVER () AS nq FROM v),
    d AS (SELECT p, q, np, nq, (below + q / 2.0::DOUBLE) / nq AS v10, (above + p / 2.0::DOUBLE) / np AS v01 FROM c),
    m AS (SELECT max(np) AS np, max(nq) AS nq, sum(p * v10) / max(np) AS auc FROM d)
"""


@query(
    "auc_midrank",
    f"WITH {STEPS.format(s='l_quantity')} SELECT cast(np AS BIGINT) AS n_pos, cast(nq AS BIGINT) AS n_neg, round(auc, 9) AS auc FROM m",
)
def auc_midrank(spark, sf_dir):
    """Area under the curve of a score with heavy ties."""
    return tidy(me.auc(_scored(spark, sf_dir), "y", "q"), 9)


@query(
    "auc_delong",
    f"""
    WITH {STEPS.format(s='l_extendedprice')},
    e AS (SELECT m.np, m.nq, auc, sqrt(sum(p * (v10 - auc) ** 2) / (m.np - 1) / m.np + sum(q * (v01 - auc) ** 2) / (m.nq - 1) / m.nq) AS se FROM d, m GROUP BY m.np, m.nq, auc)
    SELECT cast(np AS BIGINT) AS n_pos, cast(nq AS BIGINT) AS n_neg, round(auc, 9) AS auc, round(se, 9) AS se,
           round(greatest(0, auc - 1.959963984540054 * se), 9) AS lower, round(least(1, auc + 1.959963984540054 * se), 9) AS upper
    FROM e
    """,
)
def auc_delong(spark, sf_dir):
    return tidy(me.auc_ci(_scored(spark, sf_dir), "y", "s"), 9)


CONFUSION = (
    "accuracy kappa sensitivity specificity ppv npv prevalence detection_rate detection_prevalence balanced_accuracy mcnemar accuracy_lower accuracy_upper "
    "no_information no_information_p mcnemar_p"
).split()


@query(
    "confusion_at_mean",
    f"""
    WITH RECURSIVE {measures_sql("SELECT 'q' AS model, cast(l_returnflag = 'R' AS INT) AS y, l_quantity::DOUBLE AS s FROM lineitem")}
    SELECT {', '.join(f"{pick_sql(c)}::BIGINT AS {c}" for c in ('tp', 'fp', 'fn', 'tn'))}, {', '.join(f"round({pick_sql(c)}, 7) AS {c}" for c in CONFUSION)} FROM measures
    """,
)
def confusion_at_mean(spark, sf_dir):
    return tidy(me.confusion(_scored(spark, sf_dir), "y", "q"), 7)


@query(
    "ks_exact",
    """
    WITH RECURSIVE v AS (SELECT round(s_acctbal, -2) AS v, count_if(s_nationkey < 6) AS a, count_if(s_nationkey >= 6) AS b FROM supplier GROUP BY ALL),
    c AS (SELECT v, sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM v),
    d AS (SELECT any_value(n1)::BIGINT AS n1, any_value(n2)::BIGINT AS n2, max(abs(ca * n2 - cb * n1))::BIGINT AS far, list((ca + cb)::BIGINT) AS places FROM c),
    w AS (
      SELECT n1, n2, far, places, 0 AS k, list_transform(range(0, n1 + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM d WHERE n1 * n2 < 10000
      UNION ALL
      SELECT n1, n2, far, places, k + 1, list_transform(range(0, n1 + 1), lambda i:
        CASE WHEN list_contains(places, k + 1) AND abs(i * n2 - (k + 1 - i) * n1) >= far THEN 0.0::DOUBLE
             ELSE p[i + 1] * greatest(n2 - (k - i), 0) / (n1 + n2 - k) + CASE WHEN i > 0 THEN p[i] * (n1 - i + 1) / (n1 + n2 - k) ELSE 0 END END)
      FROM w WHERE k < n1 + n2)
    SELECT n1, n2, round(far / (n1 * n2)::DOUBLE, 9) AS d, round(coalesce((SELECT greatest(0, 1 - list_sum(p)) FROM w WHERE k = w.n1 + w.n2),
      least(1, greatest(0, 2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(greatest(-700, -2.0::DOUBLE * k * k * (far / (n1 * n2)::DOUBLE) ** 2
        * (n1 * n2 / (n1 + n2)::DOUBLE))) FOR k IN range(1, 2001)])))), 7) AS p_value
    FROM d
    """,
)
def ks_exact(spark, sf_dir):
    """Two samples with ties; exact while their sizes multiply to less than the bound."""
    (supplier,) = load(spark, sf_dir, "supplier")
    rows = supplier.select("s_nationkey", F.round("s_acctbal", -2).alias("v"))
    out = st.ks_2samp(rows.filter("s_nationkey < 6"), rows.filter("s_nationkey >= 6"), "v")
    return out.select("n1", "n2", F.round("d", 9).alias("d"), F.round("p_value", 7).alias("p_value"))


@query(
    "auc_paired",
    """
    WITH r AS (SELECT cast(l_returnflag = 'R' AS INT) AS y, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b FROM lineitem),
    n AS (SELECT sum(y)::DOUBLE AS np, sum(1 - y)::DOUBLE AS nq FROM r),
    pa AS (SELECT a, sum(y) AS p, sum(1 - y) AS q FROM r GROUP BY a), pb AS (SELECT b, sum(y) AS p, sum(1 - y) AS q FROM r GROUP BY b),
    ca AS (SELECT a, (sum(q) OVER (ORDER BY a) - q / 2) / nq AS lo, (np - sum(p) OVER (ORDER BY a) + p / 2) / np AS hi FROM pa, n),
    cb AS (SELECT b, (sum(q) OVER (ORDER BY b) - q / 2) / nq AS lo, (np - sum(p) OVER (ORDER BY b) + p / 2) / np AS hi FROM pb, n),
    v AS (SELECT y, CASE WHEN y = 1 THEN ca.lo ELSE ca.hi END AS va, CASE WHEN y = 1 THEN cb.lo ELSE cb.hi END AS vb FROM r JOIN ca USING (a) JOIN cb USING (b)),
    s AS (SELECT y, count(*) AS n, avg(va) AS ma, avg(vb) AS mb, (var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb)) / count(*) AS part FROM v GROUP BY y),
    f AS (SELECT sum(part) AS var, max(n) FILTER (WHERE y = 1) AS n_pos, max(n) FILTER (WHERE y = 0) AS n_neg, max(ma) FILTER (WHERE y = 1) AS a, max(mb) FILTER (WHERE y = 1) AS b FROM s)
    SELECT n_pos, n_neg, round(a, 9) AS auc_a, round(b, 9) AS auc_b, round(a - b, 9) AS difference, round(sqrt(var), 8) AS se, round((a - b) / sqrt(var), 4) AS z,
    """
    + f"round({erfc_sql('abs(a - b) / sqrt(var) / sqrt(2)')}, 5) AS p_value FROM f",
)
def auc_paired(spark, sf_dir):
    """Two scores of the same rows: the covariance of their placements."""
    found = me.auc_paired(_scored(spark, sf_dir), "y", "q", "s")
    digits = {"auc_a": 9, "auc_b": 9, "difference": 9, "se": 8, "z": 4, "p_value": 5}
    return found.select("n_pos", "n_neg", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "auc_bootstrap",
    f"""
    WITH {STEPS.format(s='l_quantity')}
    SELECT cast(np AS BIGINT) AS n_pos, cast(nq AS BIGINT) AS n_neg, round(auc, 9) AS auc, 2000 AS draws, TRUE AS near_delong FROM m
    """,
)
def auc_bootstrap(spark, sf_dir):
    """2,000 draws; both ends must lie within a quarter of a DeLong standard error of DeLong's."""
    rows = _scored(spark, sf_dir)
    drawn, closed = me.auc_bootstrap(rows, "y", "q").first(), me.auc_ci(rows, "y", "q").first()
    near = all(abs(drawn[e] - closed[e]) < closed["se"] / 4 for e in ("lower", "upper"))
    schema = "n_pos bigint, n_neg bigint, auc double, draws int, near_delong boolean"
    return spark.createDataFrame([(drawn["n_pos"], drawn["n_neg"], round(drawn["auc"], 9), drawn["draws"], near)], schema)
