"""Counts, shares and contingency tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import DataFrame, functions as F, types as T

from .categorical import driver_levels, levels_sorted

GRID_ROWS = 500_000

def freq(df: DataFrame, *keys: str, dropna: bool = False) -> DataFrame:
    """Rows per key combination. Missing values count as a level unless ``dropna``."""
    rows = df.dropna(subset=list(keys)) if dropna else df
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def level_grid(df: DataFrame, levels: Mapping[str, Sequence[object] | DataFrame]) -> DataFrame:
    """Every combination of the given levels, one row each, generated in parallel from the number of the cell.

    Levels are a list, or a table ``level, ord`` with places from 1 where a column has too many for a list.
    """
    sizes = {n: v.count() if isinstance(v, DataFrame) else len(v) for n, v in levels.items()}
    cells, step = prod(sizes.values()), prod(sizes.values())
    parts = max(1, min(cells // GRID_ROWS + 1, 100_000))
    grid = df.sparkSession.range(0, cells, 1, parts).withColumnRenamed("id", "__cell")
    for name, values in levels.items():
        kind = df.schema[name].dataType
        step //= max(1, sizes[name])
        place = F.floor(F.col("__cell") / max(1, step)) % max(1, sizes[name])
        if isinstance(values, DataFrame):
            table = values.select((F.col("ord") - 1).cast("bigint").alias("__place"), F.col("level").cast(kind).alias(name))
            grid = grid.withColumn("__place", place.cast("bigint")).join(table, "__place").drop("__place")
        else:
            known = F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(T.ArrayType(kind))
            grid = grid.withColumn(name, F.get(known, place.cast("int")))
    return grid.select(*levels)


def _levels_of(
    df: DataFrame, dims: Sequence[str], levels: Mapping[str, Sequence[object]] | None
) -> dict[str, Sequence[object] | DataFrame]:
    given: dict[str, Sequence[object] | DataFrame] = dict(levels or {})
    open_dims = [d for d in dims if d not in given]
    if open_dims:
        found = driver_levels(df, open_dims)
        for d in open_dims:
            given[d] = [v for v, _ in found[d] if v is not None] if found is not None else levels_sorted(df, d)
    return {d: given[d] for d in dims}


def freq_complete(
    df: DataFrame, dims: Sequence[str], levels: Mapping[str, Sequence[object]] | None = None, dropna: bool = True
) -> DataFrame:
    """Rows per combination of all levels; combinations without rows appear with 0.

    With ``dropna=False`` combinations that contain a missing value are kept as they occur in the data.
    """
    grid = level_grid(df, _levels_of(df, dims, levels))
    counts = freq(df, *dims, dropna=True)
    full = grid.join(counts, list(dims), "left").fillna(0, ["n"])
    if dropna:
        return full
    any_null = F.lit(False)
    for d in dims:
        any_null = any_null | F.col(d).isNull()
    return full.unionByName(freq(df.filter(any_null), *dims))


def contingency(
    df: DataFrame,
    dims: Sequence[str],
    levels: Mapping[str, Sequence[object]] | None = None,
    normalize: bool = False,
) -> DataFrame:
    """N-way table with zero cells, rows with a missing dimension left out; ``prop`` of the grand total on request."""
    table = freq_complete(df, dims, levels)
    if not normalize:
        return table
    total = df.dropna(subset=list(dims)).agg(F.count(F.lit(1))).scalar()
    return table.withColumn("prop", F.try_divide(F.col("n").cast("double"), total.cast("double")))


def prop_within(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and share per key combination, within the combination of all keys but the last.

    Parent totals are aggregated and joined, so a dominant parent is never one window partition.
    """
    counts = freq(df, *keys)
    parents = list(keys[:-1])
    if not parents:
        total = df.agg(F.count(F.lit(1))).scalar()
        return counts.withColumn("prop", F.col("n") / total.cast("double"))
    names = {k: f"__p{i}" for i, k in enumerate(parents)}
    totals = counts.groupBy(*[F.col(k).alias(names[k]) for k in parents]).agg(F.sum("n").alias("__total"))
    cond = F.lit(True)
    for k in parents:
        cond = cond & F.col(k).eqNullSafe(F.col(names[k]))
    return counts.join(totals, cond).select(*keys, "n", (F.col("n") / F.col("__total").cast("double")).alias("prop"))


def prop_total(df: DataFrame, keys: Sequence[str], levels: Mapping[str, Sequence[object]] | None = None, complete: bool = False) -> DataFrame:
    """Count and share of all rows of ``df`` (rows with missing keys stay in the denominator)."""
    counts = freq_complete(df, keys, levels, dropna=False) if complete else freq(df, *keys)
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("prop", F.col("n") / total.cast("double"))


def share_by(df: DataFrame, x: str, fill: str) -> DataFrame:
    """Share of each ``fill`` category within each ``x``: the table behind a stacked share chart."""
    return prop_within(df, [x, fill])
