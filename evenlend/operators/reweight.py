"""Reject inference by augmentation: cell weights from two populations and a resample of a third table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import round_half_even
from .frequency import prop_total, prop_within
from .joins import ratio_of_groups
from .sampling import stratified_exact


def augmentation_weights(
    all_df: DataFrame, approved_df: DataFrame, target_df: DataFrame, strata: Sequence[str]
) -> DataFrame:
    """Per cell of the target: ``n, ratio, up, weight``.

    ``ratio`` is the cell's share among all applicants over its share among approved ones, ``up`` the
    up-weighted cell count, ``weight`` the count after scaling so that the cell with the largest ratio keeps
    its size (rounded half to even). Cells are matched by key. A cell that no approved applicant fills has
    no ratio and keeps its count.
    """
    names = list(strata)
    cells = [c.dropna(subset=names) for c in (prop_total(all_df, names), prop_total(approved_df, names))]
    ratios = ratio_of_groups(cells[0], cells[1], names, "prop")
    largest = ratios.agg(F.max("ratio")).scalar()
    target = target_df.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    joined = target.join(ratios, names, "left")
    return joined.select(
        *names,
        "n",
        "ratio",
        (F.col("n") * F.col("ratio")).alias("up"),
        F.coalesce(round_half_even(F.col("n") * F.col("ratio") / largest), F.col("n").cast("double"))
        .cast("bigint")
        .alias("weight"),
    )


def reject_inference_sample(
    all_df: DataFrame,
    approved_df: DataFrame,
    target_df: DataFrame,
    strata: Sequence[str],
    key: str,
    score: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """The target resampled without replacement so that its cells follow the all-applicant population."""
    weights = augmentation_weights(all_df, approved_df, target_df, strata)
    return stratified_exact(target_df, strata, weights, key, "weight", score, seed)


def sample_check(sample: DataFrame, strata: Sequence[str], key: str) -> DataFrame:
    """Cell counts and shares of a sample, with the number of distinct keys per cell."""
    ids = sample.select(*strata, key).distinct().groupBy(*strata).agg(F.count(F.lit(1)).alias("n_keys"))
    return prop_within(sample, strata).join(ids, list(strata), "left")
