"""Model jobs: the scorecard protocol, the boosted-tree protocol and the stylised counterfactual."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import counterfactual as cf, explain as ex, glm, trees as tr
from ..session import cut_lineage


@dataclass(frozen=True)
class ScorecardReport:
    """Tables of the scorecard protocol; models are keyed ``aware`` and ``blind``."""

    models: Mapping[str, glm.LogitModel]
    coefficients: DataFrame
    fit: DataFrame
    metrics: DataFrame
    inflation: DataFrame
    test: DataFrame
    scores: Mapping[str, DataFrame]


def scorecard_protocol(
    train: DataFrame,
    holdout: DataFrame,
    features: Sequence[str],
    attr: str,
    label: str,
    key: str,
    reference: str = "frequent",
) -> ScorecardReport:
    """Logit with and without the attribute on the same rows and features, with every diagnostic."""
    spark = train.sparkSession
    rows = cut_lineage(train.select(label, *features).dropna())
    held = cut_lineage(holdout.select(key, label, *features))
    inputs = {"aware": list(features), "blind": [f for f in features if f != attr]}
    models = {n: glm.logit_fit(rows, glm.make_design(rows, label, f, reference=reference)) for n, f in inputs.items()}
    scored = {n: glm.score_logit(m, held).select(key, label, "score") for n, m in models.items()}
    metrics = [cf.metric_rows(s, label, n) for n, s in scored.items()]
    inflation = [glm.vif(m, rows).select(F.lit(n).alias("model"), "*") for n, m in models.items()]
    return ScorecardReport(
        models,
        glm.coefficients(spark, models),
        glm.pseudo_r2(spark, models),
        metrics[0].unionByName(metrics[1]),
        inflation[0].unionByName(inflation[1]),
        glm.lr_test(spark, models["blind"], models["aware"]),
        {n: s.select(key, "score") for n, s in scored.items()},
    )


def screened_scorecard(
    train: DataFrame, holdout: DataFrame, prefixes: Sequence[str], attr: str, label: str, key: str, reference: str = "frequent"
) -> tuple[DataFrame, ScorecardReport]:
    """(screening of the families, protocol on the kept ones): columns of a scorecard table are grouped by prefix, families
    whose area is not above one half on the training rows go, the attribute always stays."""
    names = [c for c in train.columns if c not in (key, label)]
    families = glm.families_by_prefix(names, prefixes, exclude=[attr])
    screened = cut_lineage(glm.screen_features(train, families, label))
    kept = {r["family"] for r in screened.filter("keep").select("family").collect()}  # one row per named prefix
    features = [c for f, own in families.items() if f in kept for c in own]
    return screened, scorecard_protocol(train, holdout, [attr, *features], attr, label, key, reference)


@dataclass(frozen=True)
class BoostReport:
    models: Mapping[str, tr.BoostModel]
    metrics: DataFrame
    importance: DataFrame
    mean_shap: DataFrame
    group_shap: DataFrame
    scores: Mapping[str, DataFrame]


def boost_models(
    train: DataFrame, features: Sequence[str], attr: str, label: str, key: str, params: tr.BoostParams = tr.BoostParams()
) -> dict[str, tr.BoostModel]:
    """Trees with and without the attribute; the key draws the same rows for both."""
    inputs = {"aware": list(features), "blind": [f for f in features if f != attr]}
    return {name: tr.gbt_fit(train, names, label, params, key) for name, names in inputs.items()}


def boost_protocol(
    train: DataFrame,
    holdout: DataFrame,
    features: Sequence[str],
    attr: str,
    label: str,
    key: str,
    params: tr.BoostParams = tr.BoostParams(),
) -> BoostReport:
    """Boosted trees with and without the attribute; each model's attributions are its own."""
    spark = train.sparkSession
    rows = cut_lineage(train.select(*dict.fromkeys([key, label, attr, *features])))
    held = cut_lineage(holdout.select(*dict.fromkeys([key, label, attr, *features])))
    models = boost_models(rows, features, attr, label, key, params)
    parts, scores = [], {}
    for name, model in models.items():
        shap = ex.shap_values(model, rows.withColumn("__group", F.col(attr)), key, ["__group", label])
        shap = cut_lineage(shap)
        scored = tr.gbt_score(model, held)
        tag = F.lit(name).alias("model")
        scores[name] = scored.select(key, "score")
        parts.append(
            (
                cf.metric_rows(scored, label, name),
                tr.importance(spark, model).select(tag, "*"),
                ex.mean_abs_shap(shap).select(tag, "*"),
                ex.shap_by_group(shap, ["__group", label]).withColumnRenamed("__group", "group").select(tag, "*"),
            )
        )
    metrics, gain, mean_shap, group_shap = (a.unionByName(b) for a, b in zip(*parts))
    return BoostReport(models, metrics, gain, mean_shap, group_shap, scores)


def stylised_counterfactual(
    df: DataFrame,
    scenarios: DataFrame,
    label: str = "Target",
    attr: str = "Gender",
    values: Sequence[str] = ("1", "2"),
    numeric: Sequence[str] = ("Income", "Score", "Age", "Tenure"),
    interact: Sequence[str] = ("Age",),
) -> tuple[DataFrame, DataFrame]:
    """(coefficients, scored scenarios) of a logit with attribute and interaction and one without both.

    Incomplete rows are left out of each fit. Scenarios are scored for both attribute values.
    """
    rows = df.withColumn(attr, F.col(attr).cast("string"))
    aware_design = glm.make_design(rows, label, [attr, *numeric], interactions=[(attr, n) for n in interact])
    aware = glm.logit_fit(rows, aware_design)
    blind = glm.logit_fit(rows, glm.make_design(rows, label, list(numeric)))
    scorers = {"aware": cf.logit_scorer(aware), "blind": cf.logit_scorer(blind)}
    table = glm.coefficients(df.sparkSession, {"aware": aware, "blind": blind})
    return table, cf.counterfactual(scenarios.drop(attr), attr, list(values), scorers)
