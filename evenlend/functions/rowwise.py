"""Statistics across the columns of one row, kept inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .missing import FLOATING, quoted


# Up to this many columns a plain expression stays inside generated code; wider rows use array functions.
FLAT_TERMS = 64


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`").cast("double") for n in names]


def row_missing_count(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """Number of NULL/NaN values in the row. An array keeps the expression flat on very wide frames."""
    wanted = list(df.columns if names is None else names)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    flags = []
    for n in wanted:
        c = quoted(n)
        flags.append(f"({c} IS NULL OR isnan({c}))" if isinstance(kinds[n], FLOATING) else f"{c} IS NULL")
    return F.expr(f"size(filter(array({', '.join(flags)}), missing -> missing))")


def row_sum(names: Sequence[str]) -> Column:
    """Sum, NULL when any term is NULL."""
    return reduce(add, _cols(names))


def row_mean(names: Sequence[str]) -> Column:
    return row_sum(names) / F.lit(float(len(names)))


def row_sd(names: Sequence[str]) -> Column:
    """Sample standard deviation (divisor n-1), NULL when any term is NULL or n is 1."""
    if len(names) < 2:
        return F.lit(None).cast(T.DoubleType())
    mean = row_mean(names)
    squares = reduce(add, [(c - mean) * (c - mean) for c in _cols(names)])
    return F.sqrt(squares / F.lit(float(len(names) - 1)))


def row_kurtosis(names: Sequence[str]) -> Column:
    """Pearson kurtosis (normal = 3) over the row; NULL for a constant row or any NULL.

    Deviations are scaled by n, which keeps 0/1 flags in exact integers.
    """
    n = F.lit(float(len(names)))
    if len(names) <= FLAT_TERMS:
        total = row_sum(names)
        squares = [(c * n - total) * (c * n - total) for c in _cols(names)]
        m2, m4 = reduce(add, squares), reduce(add, [s * s for s in squares])
        return F.when(m2 > 0, n * m4 / (m2 * m2))
    values, zero = F.array(*_cols(names)), F.lit(0.0)
    total = F.aggregate(values, zero, lambda acc, v: acc + v)
    squares = F.transform(F.transform(values, lambda v: v * n - total), lambda d: d * d)
    m2 = F.aggregate(squares, zero, lambda acc, s: acc + s)
    m4 = F.aggregate(squares, zero, lambda acc, s: acc + s * s)
    return F.when(m2 > 0, n * m4 / (m2 * m2))
