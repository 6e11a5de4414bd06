"""Paired scoring with a protected attribute flipped, and models with and without the attribute."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .glm import LogitModel, logit_fit, lr_test, make_design, pseudo_r2, score_logit
from .metrics import auc_ci, auc_paired, confusion
from .trees import BoostModel, BoostParams, gbt_fit, gbt_score

# Adds a score column of the given name to a table.
Scorer = Callable[[DataFrame, str], DataFrame]


def counterfactual_long(scenarios: DataFrame, attr: str, values: Sequence[object], scorers: Mapping[str, Scorer]) -> DataFrame:
    """Every scenario once per attribute value, with one score column ``score_<model>`` per scorer."""
    kind = scenarios.schema[attr].dataType if attr in scenarios.columns else None
    options = F.array(*[F.lit(v).cast(kind) if kind else F.lit(v) for v in values])
    out = scenarios.drop(attr).withColumn(attr, F.explode(options))
    for name, score in scorers.items():
        out = score(out, f"score_{name}")
    return out


def counterfactual(scenarios: DataFrame, attr: str, values: Sequence[object], scorers: Mapping[str, Scorer]) -> DataFrame:
    """Scenarios with ``<model>_<value>`` per attribute value and ``<model>_gap`` = last value minus first.

    The copies are scored side by side in one projection per row: no join or shuffle pairs them up.
    """
    out = scenarios
    base = [F.col(f"`{c}`") for c in scenarios.columns if c != attr]
    kind = scenarios.schema[attr].dataType if attr in scenarios.columns else None
    original = f"__{attr}"
    if kind is not None:
        out = out.withColumnRenamed(attr, original)
    scored = []
    for name, score in scorers.items():
        for v in values:
            column = f"{name}_{v}"
            out = out.withColumn(attr, F.lit(v).cast(kind) if kind else F.lit(v))
            out = score(out, column).drop(attr)
            scored.append(column)
    gaps = [
        (F.col(f"`{n}_{values[-1]}`") - F.col(f"`{n}_{values[0]}`")).alias(f"{n}_gap") for n in scorers
    ]
    back = [F.col(f"`{original}`").alias(attr)] if kind is not None else []
    return out.select(*base, *back, *[F.col(f"`{c}`") for c in scored], *gaps)


def logit_scorer(model: LogitModel) -> Scorer:
    return lambda df, out: score_logit(model, df, out)


def boost_scorer(model: BoostModel) -> Scorer:
    return lambda df, out: gbt_score(model, df, out)


def metric_rows(scored: DataFrame, label: str, model: str, score: str = "score") -> DataFrame:
    """``model, metric, value`` of the ranking and threshold measures of a scored table."""
    area = auc_ci(scored, label, score, "auto")
    table = confusion(scored, label, score)
    parts = []
    for row in (area, table):
        cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]
        parts.append(row.select(F.lit(model).alias("model"), F.inline(F.array(*cells))))
    return parts[0].unionByName(parts[1])


def _tied(model: LogitModel, df: DataFrame, digits: int = 12) -> DataFrame:
    return score_logit(model, df).withColumn("score", F.round("score", digits))


def compare_blind(
    train: DataFrame,
    holdout: DataFrame,
    attr: str,
    label: str,
    features: Sequence[str],
    interactions: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Logit with and without the attribute on the same rows: all measures of both models, and their test.

    Rows: ``model, metric, value`` with models ``aware``, ``blind`` and ``aware_vs_blind``.
    """
    spark = train.sparkSession
    complete = train.dropna(subset=[*features, label])
    aware = logit_fit(complete, make_design(complete, label, features, interactions=interactions))
    kept = [f for f in features if f != attr]
    pairs = [i for i in interactions if attr not in i]
    blind = logit_fit(complete, make_design(complete, label, kept, interactions=pairs))
    models = {"aware": aware, "blind": blind}
    fit_rows = pseudo_r2(spark, models).unpivot(
        ["model"], ["llh", "llh_null", "g2", "mcfadden", "r2ml", "r2cu"], "metric", "value"
    )
    out = fit_rows
    for name, model in models.items():
        out = out.unionByName(metric_rows(_tied(model, holdout), label, name))
    test = lr_test(spark, blind, aware).select(
        F.lit("aware_vs_blind").alias("model"), F.col("df").cast("double").alias("lr_df"), F.col("chi2").alias("lr_chi2"), F.col("p_value").alias("lr_p_value")
    )
    return out.unionByName(test.unpivot(["model"], ["lr_df", "lr_chi2", "lr_p_value"], "metric", "value"))


def compare_blind_trees(
    train: DataFrame, holdout: DataFrame, attr: str, label: str, features: Sequence[str], key: str, params: BoostParams = BoostParams(), digits: int = 12
) -> DataFrame:
    """Boosted trees with and without the attribute on the same rows: all measures of both, and the paired test of their AUCs.

    Rows: ``model, metric, value`` with models ``aware``, ``blind`` and ``aware_vs_blind``. Scores are rounded to ``digits``, so that
    equal fits tie.
    """
    scored, out = holdout, None
    for name, inputs in (("aware", list(features)), ("blind", [f for f in features if f != attr])):
        scored = gbt_score(gbt_fit(train, inputs, label, params, key), scored, name)
    scored = cut_lineage(scored.select(label, *[F.round(c, digits).alias(c) for c in ("aware", "blind")]))
    for name in ("aware", "blind"):
        rows = metric_rows(scored, label, name, name)
        out = rows if out is None else out.unionByName(rows)
    test = auc_paired(scored, label, "aware", "blind").select(
        F.lit("aware_vs_blind").alias("model"), F.col("difference").alias("auc_difference"), F.col("se").alias("auc_se"), F.col("z").alias("auc_z"), F.col("p_value").alias("auc_p_value")
    )
    return out.unionByName(test.unpivot(["model"], ["auc_difference", "auc_se", "auc_z", "auc_p_value"], "metric", "value"))
