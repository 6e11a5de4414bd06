"""Missing-value rules. Three states are kept apart until cleaning: NULL, NaN and +-Infinity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

INF = float("inf")
NAN = float("nan")
FLOATING = (T.DoubleType, T.FloatType)


def is_missing(c: Column) -> Column:
    """NULL or NaN (numeric columns)."""
    return c.isNull() | F.isnan(c)


def is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c) == F.lit(INF), F.lit(False))


def is_finite(c: Column) -> Column:
    return ~is_missing(c) & ~is_infinite(c)


def ieee_div(x: Column, y: Column) -> Column:
    """``x / y`` with floating-point rules for a zero denominator; NULL stays NULL."""
    x, y = x.cast("double"), y.cast("double")
    by_zero = (
        F.when(F.isnan(x) | (x == 0.0), F.lit(NAN))
        .when(x > 0.0, F.lit(INF))
        .when(x < 0.0, F.lit(-INF))
    )
    return F.when(y == 0.0, by_zero).otherwise(F.try_divide(x, y))


def safe_div(x: Column, y: Column) -> Column:
    """``x / y`` with NULL for a zero denominator."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def positive_part(c: Column) -> Column:
    """``max(c, 0)`` that keeps NULL (``greatest`` would turn NULL into 0)."""
    return F.when(c > 0, c).when(c <= 0, F.lit(0).cast("double"))


def sentinel_to_null(c: Column, sentinel: object) -> Column:
    return F.nullif(c, F.lit(sentinel))


def null_tokens(c: Column, tokens: Sequence[str] = ("", "NA")) -> Column:
    """String column with missing-value tokens turned into NULL."""
    return F.when(F.trim(c).isin(*tokens), None).otherwise(c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite_or_null(c: Column) -> Column:
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(INF))), c)


def quoted(name: str) -> str:
    """A column name for SQL text. Wide frames are described in SQL text: one call per column, not ten."""
    return "`" + name.replace("`", "``") + "`"


def clean_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and +-Infinity become NULL in every floating column (or in ``cols``), in one projection."""
    wanted = set(df.columns if cols is None else cols)
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if f.name in wanted and isinstance(f.dataType, FLOATING):
            out.append(f"CASE WHEN NOT (isnan({c}) OR abs({c}) = double('Infinity')) THEN {c} END AS {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)
