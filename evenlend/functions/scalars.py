"""Derived-column expressions for applicant tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: years per day used for relative day counts.
YEARS_PER_DAY = 0.002738


def days_to_years(days: Column) -> Column:
    return F.abs(days) * F.lit(YEARS_PER_DAY)


def clean_age(age: Column, year: int = 2021, oldest: int = 100, birth_year_floor: int = 1900) -> Column:
    """Negative ages are missing, values above ``birth_year_floor`` are birth years, the rest is capped to plausible."""
    years = F.when(age < 0, None).when(age > birth_year_floor, F.lit(year) - age).otherwise(age)
    return F.when(years > oldest, None).otherwise(years)


def fill_label(c: Column, label: str = "unknown") -> Column:
    return F.coalesce(c, F.lit(label))


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def above(c: Column, cut: Column | float) -> Column:
    """1 when strictly above the cut, 0 otherwise, NULL when the score is NULL."""
    cut = F.lit(cut) if isinstance(cut, (int, float)) else cut
    return F.when(c > cut, 1).when(c <= cut, 0)


def binary_code(c: Column, one: object) -> Column:
    """1 when equal to ``one``, 0 for any other value, NULL stays NULL."""
    return F.when(c == F.lit(one), 1).when(c.isNotNull(), 0)


def as_label(c: Column) -> Column:
    return c.cast("string")


def locale_key(c: Column) -> Column:
    """Sort key for labels: case-insensitive first, then the exact text."""
    return F.struct(F.lower(c).alias("folded"), c.alias("exact"))
