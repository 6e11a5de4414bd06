"""Ranking and threshold metrics of a binary score, exact and without sorting rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.formulas import Z95, chi2_1df_p, exact_proportion, normal_two_sided
from ..functions.scalars import above
from .joins import lookup_join
from .ordering import BUCKET, bucket_edges, exact_quantiles, running_totals, values_long


def score_steps(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per (group and) distinct score: its positives ``p``, negatives ``q`` and the counts up to it.

    ``weight`` names a whole number of equal rows that a row stands for.
    """
    times = F.lit(1).cast("bigint") if weight is None else F.col(f"`{weight}`").cast("bigint")
    scored = df.select(
        *[F.col(f"`{g}`") for g in groups], F.col(label).cast("int").alias("__y"), times.alias("__n"), F.col(score).cast("double").alias("__s")
    ).filter(F.col("__y").isNotNull())
    long = values_long(scored, ["__s"], [*groups, "__y", "__n"], bucket_edges(scored, ["__s"]))
    points = long.groupBy(*groups, "value", BUCKET).agg(
        *[F.sum(F.when(F.col("__y") == y, F.col("__n")).otherwise(0)).alias(c) for c, y in (("p", 1), ("q", 0))]
    )
    return running_totals(
        points, "value", {"cum_p": F.col("p"), "cum_q": F.col("q")}, groups, bucket=BUCKET, with_group_total=True
    )


def _orientation(df: DataFrame, label: str, score: str, direction: str) -> float:
    """+1 when higher scores mean the positive class; ``auto`` compares the two medians."""
    if direction != "auto":
        return 1.0 if direction == "higher" else -1.0
    rows = exact_quantiles(df.filter(F.col(label).isNotNull()), [score], [0.5], [label]).collect()
    medians = {int(r[label]): r["quantiles"][0] for r in rows}
    return -1.0 if medians.get(0, 0.0) > medians.get(1, 0.0) else 1.0


def auc_ci(
    df: DataFrame, label: str, score: str, direction: str = "higher", groups: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """``n_pos, n_neg, auc, se, lower, upper``: mid-rank AUC and its DeLong 95% interval, one row (per group).

    ``weight`` names a whole number of equal rows that a row stands for; ``auto`` directions do without.
    """
    sign = _orientation(df, label, score, direction)
    steps = score_steps(df, label, score, groups, weight)
    pos, neg = F.col("cum_p_all").cast("double"), F.col("cum_q_all").cast("double")
    below_q = (F.col("cum_q") - F.col("q")).cast("double")
    above_p = (F.col("cum_p_all") - F.col("cum_p")).cast("double")
    v10 = (below_q + F.col("q") / 2.0) / neg
    v01 = (above_p + F.col("p") / 2.0) / pos
    if sign < 0:
        v10, v01 = 1.0 - v10, 1.0 - v01
    names = [F.col(f"`{g}`") for g in groups]
    sums = steps.select(*names, "p", "q", pos.alias("np"), neg.alias("nq"), v10.alias("v10"), v01.alias("v01")).groupBy(*groups).agg(
        F.max("np").alias("np"),
        F.max("nq").alias("nq"),
        F.sum(F.col("p") * F.col("v10")).alias("s10"),
        F.sum(F.col("p") * F.col("v10") * F.col("v10")).alias("ss10"),
        F.sum(F.col("q") * F.col("v01")).alias("s01"),
        F.sum(F.col("q") * F.col("v01") * F.col("v01")).alias("ss01"),
    )
    np_, nq_ = F.col("np"), F.col("nq")
    auc = F.try_divide(F.col("s10"), np_)
    var10 = F.try_divide(F.col("ss10") - F.col("s10") * F.col("s10") / np_, np_ - 1.0)
    var01 = F.try_divide(F.col("ss01") - F.col("s01") * F.col("s01") / nq_, nq_ - 1.0)
    se = F.sqrt(F.try_divide(var10, np_) + F.try_divide(var01, nq_))
    return (
        sums.select(*names, np_.cast("bigint").alias("n_pos"), nq_.cast("bigint").alias("n_neg"), auc.alias("auc"), se.alias("se"))
        .withColumn("lower", F.greatest(F.lit(0.0), F.col("auc") - F.lit(Z95) * F.col("se")))
        .withColumn("upper", F.least(F.lit(1.0), F.col("auc") + F.lit(Z95) * F.col("se")))
    )


def auc_paired(df: DataFrame, label: str, score_a: str, score_b: str) -> DataFrame:
    """Compares the AUC of two scores of the same rows: ``n_pos, n_neg, auc_a, auc_b, difference, se, z, p_value``.

    Each row's two placement values come from tables with one row per distinct score; their covariance gives the variance of the
    difference. Rows without a label or without one of the scores are left out; equal rows are combined first.
    """
    rows = df.select(F.col(f"`{label}`").cast("int").alias("y"), *[F.col(f"`{s}`").cast("double").alias(n) for s, n in ((score_a, "a"), (score_b, "b"))])
    rows = rows.dropna().withColumns({c: F.col(c) + F.lit(0.0) for c in "ab"})
    placed = rows.groupBy("y", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("c"))
    for s in "ab":
        steps = score_steps(rows, "y", s)
        pos, neg = F.col("cum_p_all").cast("double"), F.col("cum_q_all").cast("double")
        below = F.try_divide(F.col("cum_q") - F.col("q") + F.col("q") / 2.0, neg)
        above_ = F.try_divide(F.col("cum_p_all") - F.col("cum_p") + F.col("p") / 2.0, pos)
        placed = lookup_join(placed, steps.select(F.col("value").alias(s), below.alias(f"below_{s}"), above_.alias(f"above_{s}")), s)
    own = [F.when(F.col("y") == 1, F.col(f"below_{s}")).otherwise(F.col(f"above_{s}")).alias(f"v{s}") for s in "ab"]
    c, va, vb = F.col("c"), F.col("va"), F.col("vb")
    sums = placed.select("y", "c", *own).groupBy("y").agg(
        F.sum("c").alias("n"), F.sum(c * va).alias("sa"), F.sum(c * vb).alias("sb"), F.sum(c * (va - vb)).alias("sd"), F.sum(c * (va - vb) * (va - vb)).alias("sdd")
    )
    side = {r["y"]: r for r in sums.collect()}
    schema = "n_pos bigint, n_neg bigint, auc_a double, auc_b double, difference double, se double, z double, p_value double"
    if not {0, 1} <= set(side):
        return df.sparkSession.createDataFrame([(int(side[1]["n"]) if 1 in side else 0, int(side[0]["n"]) if 0 in side else 0, *[None] * 6)], schema)
    pos, neg = side[1], side[0]
    auc_a, auc_b = pos["sa"] / pos["n"], pos["sb"] / pos["n"]
    parts = [max(0.0, r["sdd"] - r["sd"] ** 2 / r["n"]) / (r["n"] - 1.0) / r["n"] if r["n"] > 1 else float("nan") for r in (pos, neg)]
    se = sum(parts) ** 0.5
    z = (auc_a - auc_b) / se if se > 0 else None
    p = normal_two_sided(z) if z is not None else None
    return df.sparkSession.createDataFrame([(int(pos["n"]), int(neg["n"]), auc_a, auc_b, auc_a - auc_b, se, z, p)], schema)


def auc_bootstrap(df: DataFrame, label: str, score: str, draws: int = 2000, seed: int = 0, direction: str = "higher") -> DataFrame:
    """``n_pos, n_neg, auc, draws, lower, upper``: the AUC and the 2.5% and 97.5% points of its bootstrap distribution.

    Each class is drawn anew by giving every row a Poisson(1) number of copies; the copies of a class at one score are then
    Poisson with their number as mean, so draws need the table of score steps only. A step's copies follow from its value,
    class and the seed. Range buckets of steps send three sums per draw; earlier buckets' negatives are added by a window.
    """
    sign = _orientation(df, label, score, direction)
    steps = score_steps(df, label, score).select("value", BUCKET, F.col("p").alias("pos"), F.col("q").alias("neg"))
    steps = steps.withColumn("h", F.xxhash64(F.lit(seed), "value"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("value")
        pos_sum, neg_sum, pairs = np.zeros(draws), np.zeros(draws), np.zeros(draws)
        for h, p, q in zip(part["h"], part["pos"], part["neg"]):
            copies = [np.random.Generator(np.random.PCG64([int(h) & (2**64 - 1), side])).poisson(k, draws) if k else 0 for side, k in enumerate((p, q))]
            pairs += copies[0] * (neg_sum + copies[1] / 2.0)
            pos_sum += copies[0]
            neg_sum += copies[1]
        return pd.DataFrame({"bucket": part[BUCKET].iloc[:1].astype("float64"), "draw": [np.arange(draws)], "p": [pos_sum], "q": [neg_sum], "pairs": [pairs]})

    sums = steps.groupBy(BUCKET).applyInPandas(run, "bucket double, draw array<int>, p array<double>, q array<double>, pairs array<double>")
    long = sums.select("bucket", F.inline(F.arrays_zip("draw", "p", "q", "pairs")))
    before = Window.partitionBy("draw").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = long.withColumn("pairs", F.col("pairs") + F.col("p") * F.coalesce(F.sum("q").over(before), F.lit(0.0)))
    drawn = whole.groupBy("draw").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("pairs").alias("pairs"))
    area = F.try_divide(F.col("pairs"), F.col("p") * F.col("q"))
    # One row per draw.
    ends = drawn.select((area if sign > 0 else 1.0 - area).alias("area")).agg(F.percentile("area", F.array(F.lit(0.025), F.lit(0.975))).alias("ends"))
    found = auc_ci(df, label, score, "higher" if sign > 0 else "lower").select("n_pos", "n_neg", "auc")
    both = found.withColumn("ends", ends.scalar())
    return both.select("n_pos", "n_neg", "auc", F.lit(draws).alias("draws"), F.get("ends", F.lit(0)).alias("lower"), F.get("ends", F.lit(1)).alias("upper"))


def auc(df: DataFrame, label: str, score: str, direction: str = "higher") -> DataFrame:
    return auc_ci(df, label, score, direction).select("n_pos", "n_neg", "auc")


def confusion(df: DataFrame, label: str, score: str, cut: str | float = "mean") -> DataFrame:
    """One row of threshold measures; the positive class is 1 and a prediction is 1 when score > cut.

    ``accuracy_lower, accuracy_upper`` are the exact binomial 95% interval, ``no_information`` the share of the larger class and
    ``no_information_p`` the chance of as many hits at that share.
    """
    rows = df.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    threshold = rows.agg(F.avg("s")).scalar() if cut == "mean" else F.lit(float(cut))
    called = rows.dropna().select("y", above(F.col("s"), threshold).alias("hat"))

    def cell(hat: int, y: int):
        return F.count_if((F.col("hat") == hat) & (F.col("y") == y)).cast("double")

    counts = called.agg(
        cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    agree = (tp + tn) / n
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    gap = F.greatest(F.abs(fp - fn) - 1.0, F.lit(0.0))
    most = F.greatest(tp + fn, fp + tn) / n
    counts = counts.withColumn("exact", exact_proportion(tp + tn, n, most))
    return counts.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")],
        agree.alias("accuracy"),
        F.try_divide(agree - chance, 1.0 - chance).alias("kappa"),
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        F.try_divide(tp, tp + fp).alias("ppv"),
        F.try_divide(tn, tn + fn).alias("npv"),
        ((tp + fn) / n).alias("prevalence"),
        (tp / n).alias("detection_rate"),
        ((tp + fp) / n).alias("detection_prevalence"),
        ((sens + spec) / 2.0).alias("balanced_accuracy"),
        F.try_divide(gap * gap, fp + fn).alias("mcnemar"),
        *[F.get("exact", F.lit(i)).alias(c) for i, c in enumerate(("accuracy_lower", "accuracy_upper"))],
        most.alias("no_information"),
        F.get("exact", F.lit(2)).alias("no_information_p"),
        chi2_1df_p(F.try_divide(gap * gap, fp + fn)).alias("mcnemar_p"),
    )
