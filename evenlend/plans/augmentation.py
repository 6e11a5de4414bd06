"""Reject-inference job: bring two lenders' applicants to one form, compare populations, resample the test set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as sc
from ..operators import binning as bi, categorical as ca, columns as co, frequency as fr, joins as jn, reweight as rw, stats as st
from . import presets as ps

DIMENSIONS = (
    "CODE_GENDER",
    "YEARS_BIRTH_BIN",
    "NAME_FAMILY_STATUS",
    "INCOME_BIN",
    "OCCUPATION_TYPE",
    "Target",
    "APPLICATION_STATUS",
)
STRATA = ("INCOME_BIN", "OCCUPATION_TYPE")


def _binned(df: DataFrame, income_bins: int, age_bins: int) -> DataFrame:
    """Adds ``YEARS_BIRTH_BIN`` (round edges) and ``INCOME_BIN`` (quantile position, own edges)."""
    aged = bi.bin_pretty(df, "YEARS_BIRTH", age_bins).drop("YEARS_BIRTH_bin")  # names are case-insensitive
    paid = bi.bin_quantile(aged, "AMT_INCOME_TOTAL", income_bins, labels=False)
    return paid.withColumnsRenamed({"YEARS_BIRTH_label": "YEARS_BIRTH_BIN", "AMT_INCOME_TOTAL_bin": "INCOME_BIN"})


def harmonise_test(test: DataFrame, income_bins: int = 4, age_bins: int = 10) -> DataFrame:
    """Coded applicants of the first lender in the common form; all of them count as approved."""
    named = ca.relabel_codes(test, "CODE_GENDER", ps.GENDERS)
    named = ca.relabel_codes(named, "NAME_FAMILY_STATUS", ps.FAMILY_STATUS)
    code = F.col("OCCUPATION_TYPE").cast("int")
    jobs = F.get(F.array(*[F.lit(v) for v in ps.OCCUPATIONS]), code - 1)
    named = named.withColumns(
        {
            "OCCUPATION_TYPE": ca.collapse_expr(sc.fill_label(jobs), ps.OTHER_OCCUPATIONS),
            "YEARS_BIRTH": sc.days_to_years(F.col("DAYS_BIRTH")),
            "APPLICATION_STATUS": F.lit("approved"),
        }
    )
    return _binned(named, income_bins, age_bins)


def harmonise_second_lender(
    bank: DataFrame, occupations: DataFrame, old: str = "oldnames", new: str = "newnames", income_bins: int = 4, age_bins: int = 10
) -> DataFrame:
    """The second lender's applicants in the common form. Bins use all rows, before statuses are filtered."""
    named = co.rename(bank, ps.SECOND_LENDER_NAMES)
    named = ca.relabel(named, "CODE_GENDER", [*ps.GENDERS, None])
    named = named.withColumns(
        {
            "YEARS_BIRTH": sc.clean_age(F.col("YEARS_BIRTH")),
            "NAME_FAMILY_STATUS": ca.collapse_expr(F.col("NAME_FAMILY_STATUS"), ps.MARITAL_GROUPS),
            "OCCUPATION_TYPE": sc.fill_label(F.col("OCCUPATION_TYPE")),
            "APPLICATION_STATUS": ca.collapse_expr(F.col("APPLICATION_STATUS"), ps.STATUS_GROUPS),
        }
    )
    matched = jn.recode_by_table(named, "OCCUPATION_TYPE", occupations, old, new)
    return _binned(ca.collapse_levels(matched, "OCCUPATION_TYPE", ps.OTHER_OCCUPATIONS), income_bins, age_bins)


def decided(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved and rejected, approved only)."""
    everyone = co.filter_any_match(bank, "APPLICATION_STATUS", ps.DECIDED)
    return everyone, everyone.filter(F.col("APPLICATION_STATUS") == "approved")


def joint_distribution(df: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Seven-way table with zero cells and shares."""
    return fr.contingency(df, dims, normalize=True)


def compare_populations(everyone: DataFrame, approved: DataFrame, dims: Sequence[str] = DIMENSIONS[:5]) -> DataFrame:
    """Share tests of every level of each dimension, and of gender by outcome: ``dimension, level, ...``."""
    out = None
    for d in dims:
        tested = st.prop_test_by(everyone, approved, [d]).withColumns(
            {"dimension": F.lit(d), "level": F.col(d).cast("string")}
        )
        tested = tested.drop(d)
        out = tested if out is None else out.unionByName(tested)
    known = [c.dropna(subset=["CODE_GENDER"]) for c in (everyone, approved)]
    crossed = st.prop_test_by(*known, ["Target", "CODE_GENDER"]).withColumns(
        {"dimension": F.lit("Target:CODE_GENDER"), "level": F.concat_ws(":", F.col("Target").cast("string"), "CODE_GENDER")}
    )
    return out.unionByName(crossed.drop("Target", "CODE_GENDER"))


def augmented_test(test: DataFrame, everyone: DataFrame, approved: DataFrame, key: str, seed: int = 0, score: Column | None = None) -> DataFrame:
    """The first lender's test set resampled so that income by occupation follows all applicants."""
    return rw.reject_inference_sample(everyone, approved, test.dropna(subset=["INCOME_BIN"]), STRATA, key, score, seed)
