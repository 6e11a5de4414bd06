"""Binomial-logit models with inference, diagnostics and prediction as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.formulas import chi2_tail, normal_quantiles, normal_two_sided, two_sided
from ..session import LEVEL_CAP, cut_lineage, work_partitions
from .categorical import closed_levels, label_counts, ranked_levels
from .designs import ALIAS_TOLERANCE, INTERCEPT, Design, LogitModel, LongLevels
from .metrics import auc_ci
from .ordering import value_positions
from .sparse_glm import countable_keys, fit_long, fit_many, long_predictors, pattern_counts, predictor, score_many

SCORE_DIGITS = 9  # of screened scores; less than rounding apart, they count as tied
SUMMED = 8  # up to so many columns their products are summed as columns, without vectors
WIDE = 64  # more columns than this are fitted and scored from sparse rows, not from one expression per column


def make_design(
    df: DataFrame,
    label: str,
    features: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    interactions: Sequence[tuple[str, str]] = (),
    reference: str = "sorted",
    cap: int = LEVEL_CAP,
) -> Design:
    """All columns but the label and ``exclude`` (or the listed ``features``); text columns are factors.

    ``reference`` picks the reference level of each factor: the first in sorted order or the most frequent. A factor that is the only
    feature keeps its levels as a table if they are more than ``cap``.
    """
    names = [c for c in (features or df.columns) if c not in {label, *exclude}]
    text = [n for n in names if isinstance(df.schema[n].dataType, (T.StringType, T.BooleanType))]
    if text and len(names) == 1 and not interactions:
        table = cut_lineage(label_counts(df, text))
        if table.count() > cap:
            return Design(label, tuple(names), {names[0]: _long_levels(table, reference)})
        found = ranked_levels(table, text)
    else:
        found = closed_levels(df, text) if text else {}
    levels = {}
    for n in text:
        ranked = [(v, k) for v, k in found[n] if v is not None]
        if reference == "frequent" and ranked:
            first = max(ranked, key=lambda x: x[1])
            ranked = [first, *[x for x in ranked if x is not first]]
        levels[n] = tuple(v for v, _ in ranked)
    return Design(label, tuple(names), levels, tuple(tuple(i) for i in interactions))


def _long_levels(counts: DataFrame, reference: str) -> LongLevels:
    table = counts.dropna(subset=["level"]).select("level", "n", F.lower("level").alias("folded"))
    order = [(-F.col("n")).alias("few")] if reference == "frequent" else []
    size, first = table.agg(F.count(F.lit(1)), F.min(F.struct(*order, "folded", "level")).alias("first")).first()
    return LongLevels(table.select("level", "folded"), size, first["level"])


def gramian(df: DataFrame, columns: Mapping[str, Column], weight: Column | None = None) -> np.ndarray:
    """``X' W X`` of [1, columns] over complete rows; only the p-by-p matrix reaches the driver. Few columns are plain sums."""
    if len(columns) <= SUMMED:
        each, w = [F.lit(1.0), *[c.cast("double") for c in columns.values()]], F.lit(1.0) if weight is None else weight
        named = df.select(w.alias("w"), *[c.alias(f"x{i}") for i, c in enumerate(each)]).dropna()
        pairs = [(i, j) for i in range(len(each)) for j in range(i + 1)]
        sums = named.agg(*[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
        out = np.zeros((len(each), len(each)))
        for (i, j), v in zip(pairs, sums):
            out[i, j] = out[j, i] = v or 0.0
        return out
    root = F.lit(1.0) if weight is None else F.sqrt(weight)
    scaled = [root.alias("x0"), *[(c * root).alias(f"x{i + 1}") for i, c in enumerate(columns.values())]]
    rows = df.select(*scaled).dropna()
    vectors = VectorAssembler(inputCols=rows.columns, outputCol="v").transform(rows).select("v")
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"))
    return matrix.computeGramianMatrix().toArray()


def aliased_columns(gram: np.ndarray, names: Sequence[str], tolerance: float = ALIAS_TOLERANCE) -> list[str]:
    """Columns that are linear combinations of the intercept and earlier columns.

    ``gram`` is of centred columns, so the share of variance that earlier columns leave unexplained does not depend on
    a column's offset or unit. One Cholesky factorisation in column order finds them all.
    """
    spread_of = np.diag(gram)[1:]
    scale = np.sqrt(np.where(spread_of > 0, spread_of, 1.0))
    unit = gram[1:, 1:] / np.outer(scale, scale)
    kept: list[int] = []
    factor = np.zeros((len(names), len(names)))
    dropped = []
    for j, name in enumerate(names):
        row = factor[j]
        for c, i in enumerate(kept):
            row[c] = (unit[j, i] - row[:c] @ factor[i, :c]) / factor[i, c]
        left = unit[j, j] - row[: len(kept)] @ row[: len(kept)] if spread_of[j] > 0 else 0.0
        if left < tolerance:
            dropped.append(name)
            continue
        factor[j, len(kept)] = math.sqrt(left)
        kept.append(j)
    return dropped


def counted_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with their number ``n``: equal rows once, where at most half of the rows are different (by a sketch), else every row with 1."""
    total, different = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*rows.columns))).first()
    own = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("n")) if different * 2 <= total else rows.withColumn("n", F.lit(1.0))
    return own.repartition(work_partitions(rows.sparkSession))


def logit_fit(df: DataFrame, design: Design, max_iter: int = 50, tol: float = 1e-10) -> LogitModel:
    """Maximum-likelihood fit on the complete rows, equal ones with their number as weight. Aliased columns are left out and reported.

    Designs of more than ``WIDE`` columns are fitted from sparse rows, factors with a table of levels from the counts of the levels.
    """
    if design.long is not None:
        return fit_long(df, design, max_iter, tol)
    if len(design.names()) > WIDE:
        return fit_many(df, {"wide": design}, max_iter, tol)["wide"]
    columns = design.columns()
    names = [f"x{i}" for i in range(len(columns))]
    rows = df.select(
        F.col(f"`{design.label}`").cast("double").alias("y"), *[c.alias(n) for n, c in zip(names, columns.values())]
    ).dropna()
    times = F.col("n")
    rows = counted_rows(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        middle = rows.agg(*[(F.sum(F.col(n) * times) / F.sum(times)).alias(n) for n in names]).first() if names else {}
        centred = {n: F.col(n) - F.lit(float(middle[n] or 0.0)) for n in names}
        dropped = set(aliased_columns(gramian(rows, centred, times), names))
        used = [n for n in names if n not in dropped]
        labels = dict(zip(names, columns))
        if not used:
            return _null_model(rows, design, tuple(labels[n] for n in names))
        # The solver starts a row at (weight * y + 0.5) / (weight + 1): weights beyond 1 would start it at the label itself and may diverge.
        most = rows.agg(F.max("n")).first()[0]
        moved = rows.select("y", (times / F.lit(most)).alias("n"), *[centred[n].alias(n) for n in used])
        data = VectorAssembler(inputCols=used, outputCol="features").transform(moved).select("y", "n", "features")
        fit = GeneralizedLinearRegression(
            family="binomial", link="logit", labelCol="y", weightCol="n", maxIter=max_iter, tol=tol
        ).fit(data)
        slopes = [float(v) for v in fit.coefficients]
        offsets = np.array([1.0, *[-float(middle[n]) for n in used]])
        eta = _balanced_sum([F.lit(fit.intercept), *[centred[n] * F.lit(v) for n, v in zip(used, slopes)]])
        p = 1.0 / (1.0 + F.exp(-eta))
        covariance = np.linalg.inv(gramian(rows, {n: centred[n] for n in used}, times * p * (1.0 - p)))
        errors = np.sqrt(np.diag(covariance))[1:].tolist()
        intercept = fit.intercept + float(offsets[1:] @ slopes)
        estimates = {INTERCEPT: intercept, **{labels[n]: v for n, v in zip(used, slopes)}}
        intercept_error = math.sqrt(float(offsets @ covariance @ offsets))
        n, positives, loss = rows.agg(F.sum(times).cast("bigint"), F.sum(times * F.col("y")), F.sum(times * _log_loss(F.col("y"), eta))).first()
        deviance = 2.0 * loss
        return LogitModel(
            design,
            estimates,
            {INTERCEPT: intercept_error, **{labels[n]: e for n, e in zip(used, errors)}},
            deviance,
            _null_deviance(n, positives),
            deviance + 2.0 * len(estimates),
            n,
            tuple(labels[n] for n in names if n in dropped),
        )
    finally:
        rows.unpersist()


def _log_loss(y: Column, eta: Column) -> Column:
    """``log(1 + exp(eta)) - y * eta`` without overflow."""
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - y * eta


def _null_deviance(n: int, positives: float) -> float:
    return -2.0 * sum(k * math.log(k / n) for k in (positives, n - positives) if k > 0)


def _null_model(rows: DataFrame, design: Design, dropped: tuple[str, ...]) -> LogitModel:
    n, positives = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint"), F.sum(F.col("n") * F.col("y"))).first()
    share = positives / n if n else float("nan")
    inside = 0.0 < share < 1.0
    odds = math.log(share / (1 - share)) if inside else float("nan")
    se = 1.0 / math.sqrt(n * share * (1 - share)) if inside else float("nan")
    deviance = _null_deviance(n, positives) if n else 0.0
    return LogitModel(design, {INTERCEPT: odds}, {INTERCEPT: se}, deviance, deviance, deviance + 2.0, n, dropped)


def _balanced_sum(terms: list[Column]) -> Column:
    """Sum as a shallow tree: a chain of several hundred terms is too deep for the planner."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def linear_predictor(model: LogitModel) -> Column:
    if len(model.design.names()) > WIDE:
        return predictor(model)
    columns = model.design.columns()
    terms = [F.lit(float(model.estimates[INTERCEPT]))]
    terms += [columns[n] * F.lit(float(b)) for n, b in model.estimates.items() if n != INTERCEPT]
    # columns that were aliased still decide whether a row is complete
    terms += [columns[n] * F.lit(0.0) for n in model.aliased]
    return _balanced_sum(terms)


def predicted(model: LogitModel) -> Column:
    """Predicted probability as one expression; NULL for rows with a missing or unknown input."""
    return 1.0 / (1.0 + F.exp(-linear_predictor(model)))


def score_logit(model: LogitModel, df: DataFrame, out: str = "score") -> DataFrame:
    if model.table is not None:
        level = F.col(f"`{model.design.features[0]}`").cast("string")
        joined = df.withColumn("__level", level).join(long_predictors(model), "__level", "left")
        scored = joined.withColumn(out, 1.0 / (1.0 + F.exp(-F.col("__link"))))
        return scored.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*df.columns, out])])
    return df.withColumn(out, predicted(model))


def coefficients(spark: SparkSession, models: Mapping[str, LogitModel]) -> DataFrame:
    """Coefficient tables of several models: ``model, term, estimate, se, z, p_value``; aliased terms are NULL."""
    rows, long = [], []
    for name, m in models.items():
        if m.table is not None:
            first = [(INTERCEPT, m.estimates[INTERCEPT], m.errors[INTERCEPT])] + [(t, None, None) for t in m.aliased.first]
            terms = m.table.unionByName(spark.createDataFrame(first, "term string, estimate double, se double"))
            z = F.when(F.col("se") != 0.0, F.col("estimate") / F.col("se"))
            long.append(terms.select(F.lit(name).alias("model"), "term", "estimate", "se", z.alias("z")).withColumn("p_value", two_sided(F.col("z"))))
            continue
        for term, b in m.estimates.items():
            se = m.errors[term]
            z = b / se if se else None
            rows.append((name, term, b, se, z, normal_two_sided(z) if z is not None else None))
        rows += [(name, term, None, None, None, None) for term in m.aliased]
    schema = "model string, term string, estimate double, se double, z double, p_value double"
    return reduce(DataFrame.unionByName, long, spark.createDataFrame(rows, schema))


def pseudo_r2(spark: SparkSession, models: Mapping[str, LogitModel]) -> DataFrame:
    rows = []
    for name, m in models.items():
        g2 = m.null_deviance - m.deviance
        ml = 1.0 - math.exp(-g2 / m.n)
        cu = ml / (1.0 - math.exp(-m.null_deviance / m.n))
        rows.append((name, -m.deviance / 2, -m.null_deviance / 2, g2, 1.0 - m.deviance / m.null_deviance, ml, cu))
    schema = "model string, llh double, llh_null double, g2 double, mcfadden double, r2ml double, r2cu double"
    return spark.createDataFrame(rows, schema)


def lr_test(spark: SparkSession, small: LogitModel, big: LogitModel) -> DataFrame:
    """Likelihood-ratio test of nested models fitted on the same rows."""
    if small.n != big.n:
        raise ValueError(f"models were fitted on {small.n} and {big.n} rows")
    df = big.parameters - small.parameters
    stat = small.deviance - big.deviance
    return spark.createDataFrame([(df, stat, chi2_tail(stat, df))], "df int, chi2 double, p_value double")


def vif(model: LogitModel, df: DataFrame) -> DataFrame:
    """Generalised variance inflation per formula term: ``term, df, gvif, tolerance``."""
    columns = {n: c for n, c in model.design.columns().items() if n in model.estimates}
    p = predicted(model)
    gram = gramian(df.filter(F.col(f"`{model.design.label}`").isNotNull()), columns, p * (1.0 - p))
    cov = np.linalg.inv(gram)[1:, 1:]
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    order = {n: i for i, n in enumerate(columns)}
    whole = np.linalg.slogdet(corr)[1]
    rows = []
    for term, block in model.design.blocks().items():
        mine = [order[n] for n in block if n in order]
        if not mine:
            continue
        rest = [i for i in range(len(order)) if i not in mine]
        log = np.linalg.slogdet(corr[np.ix_(mine, mine)])[1] - whole
        log += np.linalg.slogdet(corr[np.ix_(rest, rest)])[1] if rest else 0.0
        g = float(np.exp(log))
        rows.append((term, len(mine), g, 1.0 / g))
    return df.sparkSession.createDataFrame(rows, "term string, df int, gvif double, tolerance double")


def residuals(model: LogitModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Fitted values, linear predictor and deviance residuals per row."""
    y = F.col(f"`{model.design.label}`").cast("double")
    loss = 2.0 * _log_loss(y, F.col("link"))
    return (
        df.select(*keep, model.design.label, linear_predictor(model).alias("link"))
        .withColumn("fitted", 1.0 / (1.0 + F.exp(-F.col("link"))))
        .withColumn("deviance_residual", F.signum(y - F.col("fitted")) * F.sqrt(loss))
    )


def influence(model: LogitModel, df: DataFrame, keep: Sequence[str], positions: bool = True) -> DataFrame:
    """What the fit plots show, for every complete row.

    Adds to ``residuals``: Pearson residual, leverage (the row's quadratic form in the fitted covariance, times its weight),
    both residuals standardised by it, Cook's distance, and the plotting position of the standardised deviance residual
    with its normal quantile. Equal residuals share the middle of their positions. Without ``positions`` those two columns are left out,
    and no row is shuffled.
    """
    label = model.design.label
    columns = {n: c for n, c in model.design.columns().items() if n in model.estimates}
    p = predicted(model)
    rows = df.filter(F.col(f"`{label}`").isNotNull())
    root = np.linalg.cholesky(np.linalg.inv(gramian(rows, columns, p * (1.0 - p))))

    @F.arrow_udf("double")
    def form(values: pa.Array) -> pa.Array:
        x = pc.list_flatten(values).to_numpy(zero_copy_only=False).reshape(len(values), -1)
        return pa.array(((x @ root) ** 2).sum(axis=1))

    ready = rows.withColumn("__form", F.array(F.lit(1.0), *columns.values())).withColumn("link", linear_predictor(model)).filter("link IS NOT NULL")
    y, fitted = F.col(f"`{label}`").cast("double"), F.col("fitted")
    weight = fitted * (1.0 - fitted)
    scored = ready.select(*keep, label, "link", (1.0 / (1.0 + F.exp(-F.col("link")))).alias("fitted"), form("__form").alias("__form"))
    scored = scored.withColumns(
        {
            "deviance_residual": F.signum(y - fitted) * F.sqrt(2.0 * _log_loss(y, F.col("link"))),
            "pearson_residual": (y - fitted) / F.sqrt(weight),
            "leverage": F.col("__form") * weight,
        }
    ).drop("__form")
    left = 1.0 - F.col("leverage")
    scored = scored.withColumns(
        {
            "std_deviance": F.col("deviance_residual") / F.sqrt(left),
            "std_pearson": F.col("pearson_residual") / F.sqrt(left),
            "cook": F.pow(F.col("pearson_residual") / left, 2) * F.col("leverage") / float(model.parameters),
        }
    )
    if not positions:
        return scored
    steps = value_positions(scored, "std_deviance")
    edge = F.when(F.col("n") <= 10, 0.375).otherwise(0.5)
    steps = steps.withColumn("position", (F.col("middle") - edge) / (F.col("n") + 1.0 - 2.0 * edge))
    steps = steps.select("std_deviance", "position", normal_quantiles(F.col("position")).alias("normal_quantile"))
    return scored.join(steps, "std_deviance").select(*scored.columns, "position", "normal_quantile")


def score_equations(model: LogitModel, df: DataFrame) -> DataFrame:
    """``sum(x * (y - p))`` per estimated column: zero at the maximum of the likelihood."""
    columns = {INTERCEPT: F.lit(1.0), **{n: c for n, c in model.design.columns().items() if n in model.estimates}}
    gap = F.col(f"`{model.design.label}`").cast("double") - predicted(model)
    row = df.agg(*[F.sum(c * gap).alias(f"s{i}") for i, c in enumerate(columns.values())])
    cells = [F.struct(F.lit(n).alias("term"), F.col(f"s{i}").alias("score")) for i, n in enumerate(columns)]
    return row.select(F.inline(F.array(*cells)))


def counted_levels(single: DataFrame) -> dict[str, tuple[str, ...]]:
    """Levels of each feature in the order of ``closed_levels``, from pattern counts with one feature a model."""
    rows = single.select("model", F.get("key", F.lit(0)).alias("level")).dropna().distinct().withColumn("folded", F.lower("level")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["folded"], r["level"])):
        out.setdefault(r["model"], []).append(r["level"])
    return {f: tuple(found) for f, found in out.items()}


def screen_features(
    train: DataFrame, families: Mapping[str, Sequence[str]], label: str, test: DataFrame | None = None
) -> DataFrame:
    """One model per feature family: ``family, auc, lower, upper, crosses_half, keep``.

    A family is kept when the whole 95% interval of its AUC lies above one half. All families are fitted in the same passes
    and scored in one, those of few combinations of levels from their counts; a family whose rows all have one label has no interval.
    """
    features = list(dict.fromkeys(f for own in families.values() for f in own))
    text = [f for f in features if isinstance(train.schema[f].dataType, (T.StringType, T.BooleanType))]
    single = pattern_counts(train, label, {f: [f] for f in text})
    levels = counted_levels(single)
    designs = {n: Design(label, tuple(own), {f: levels.get(f, ()) for f in own if f in text}) for n, own in families.items()}
    keys = countable_keys(designs)
    alone = {n: own[0] for n, own in keys.items() if len(own) == 1}
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("feature")) for n, f in alone.items()])) if alone else None
    counted = pattern_counts(train, label, {n: own for n, own in keys.items() if n not in alone})
    if alone:
        pairs = train.sparkSession.range(1).select(named.alias("p")).select("p.name", "p.feature")  # one row per family
        counted = counted.unionByName(single.join(F.broadcast(pairs), F.col("model") == F.col("feature")).select(F.col("name").alias("model"), "key", "y", "n"))
    models = fit_many(train, designs, counted=counted)
    scored = score_many(train, models, SCORE_DIGITS, counted) if test is None else score_many(test, models, SCORE_DIGITS)
    areas = auc_ci(scored, "y", "score", groups=["model"], weight="n")
    return areas.select(
        F.col("model").alias("family"),
        "auc",
        "lower",
        "upper",
        ((F.col("lower") <= 0.5) & (F.col("upper") >= 0.5)).alias("crosses_half"),
        (F.col("lower") > 0.5).alias("keep"),
    )


def families_by_prefix(columns: Sequence[str], prefixes: Sequence[str], exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    """Columns of each prefix (the longest one counts), for dummies of binned features; prefixes without columns are left out."""
    out: dict[str, list[str]] = {p: [] for p in prefixes}
    for c in columns:
        own = max((p for p in prefixes if c.startswith(p)), key=len, default=None)
        if own is not None and c not in exclude:
            out[own].append(c)
    return {p: found for p, found in out.items() if found}
