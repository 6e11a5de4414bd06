"""Joins, lookups, unions and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_CELLS, BROADCAST_ROWS, cut_lineage
from .ordering import with_row_number

HOT_ROWS = 2_000_000


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS, cells: int = BROADCAST_CELLS) -> bool:
    """Counts at most ``rows``+1 rows of ``table`` and says whether it is small enough to broadcast."""
    bound = min(rows, max(1, cells // max(1, len(table.columns))))
    return table.limit(bound + 1).count() <= bound


def salted_join(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equi join in which every key with more than ``hot_rows`` rows in ``df`` is spread over tasks of about that size.

    Keys are counted first; only hot ones get salts, as many as their count asks for, and only their rows of ``table``
    are repeated. The salt is a hash of the row, so a retried task places each row where it was before.
    """
    salt, salts = "__salt", "__salts"
    counts = df.groupBy(*[F.col(f"`{c}`") for c in on]).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    hot = cut_lineage(counts.select(*[F.col(f"`{c}`") for c in on], F.ceil(F.col("__n") / hot_rows).cast("int").alias(salts)))
    if hot.isEmpty():
        return df.join(table, list(on), how)
    side = F.broadcast(hot) if fits_broadcast(hot) else hot
    left, right = df.join(side, list(on), "left"), table.join(side, list(on), "left")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    left = left.withColumn(salt, F.when(F.col(salts).isNotNull(), F.pmod(row, F.col(salts)).cast("int")).otherwise(0)).drop(salts)
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    return left.join(right, [*on, salt], how).drop(salt)


def lookup_join(
    df: DataFrame, table: DataFrame, on: Sequence[str] | str, how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a lookup table on possibly hot keys: broadcast when counted small, salted otherwise."""
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(table, max_rows):
        return df.join(F.broadcast(table), keys, how)
    return salted_join(df, table, keys, how)


def left_attach(parent: DataFrame, agg: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join of a table with one row per key; an aggregate by ``key`` is already partitioned by it."""
    return parent.join(agg, [key] if isinstance(key, str) else list(key), "left")


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") if c in keep else F.col(f"`{c}`").alias(f"{prefix}__{c}") for c in df.columns])


def star_join(
    base: DataFrame,
    sides: Mapping[str, DataFrame],
    key: str,
    suffixes: tuple[str, str] | None = None,
) -> DataFrame:
    """Left joins of several one-row-per-key tables on one key.

    Columns are prefixed with the side's name; with ``suffixes`` only clashing names change, the earlier
    one to ``name + suffixes[0]`` and the later one to ``name + suffixes[1]``.
    """
    out = base
    for name, side in sides.items():
        if suffixes is None:
            side = prefix_columns(side, name, [key])
        else:
            clash = (set(out.columns) & set(side.columns)) - {key}
            out = out.withColumnsRenamed({c: c + suffixes[0] for c in clash})
            side = side.withColumnsRenamed({c: c + suffixes[1] for c in clash})
        out = left_attach(out, side, key)
    return out


def reattach(ids: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Features for a saved id frame; ids without features stay, with NULLs."""
    return ids.select(key).join(features, key, "left")


def sample_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the id list."""
    wanted = ids.select(key).distinct()
    return df.join(F.broadcast(wanted), key, "left_semi") if fits_broadcast(wanted) else df.join(wanted, key, "left_semi")


def sample_by_rownum(df: DataFrame, ids: DataFrame, order_key: str, id_col: str = "row_number") -> DataFrame:
    """Rows whose 1-based position by ``order_key`` is in the list of row numbers.

    Only the key column is numbered and shuffled; the wide rows are filtered by the keys that were picked.
    """
    numbered = with_row_number(df.select(order_key), order_key, id_col)
    return sample_by_ids(df, sample_by_ids(numbered, ids, id_col), order_key)


def recode_by_table(df: DataFrame, col: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Replace labels by a mapping table; labels without a match stay as they are."""
    table = mapping.groupBy(F.col(old).alias(col)).agg(F.min(new).alias("__new"))
    joined = lookup_join(df, table, col)
    return joined.select(
        *[F.coalesce("__new", F.col(f"`{c}`")).alias(c) if c == col else F.col(f"`{c}`") for c in df.columns]
    )


def ratio_of_groups(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, out: str = "ratio") -> DataFrame:
    """``a.value / b.value`` per key, aligned by key; a cell missing on either side counts as 0."""
    none = F.lit(None).cast("double")
    left = a.select(*keys, F.col(value).cast("double").alias("__a"), none.alias("__b"))
    right = b.select(*keys, none.alias("__a"), F.col(value).cast("double").alias("__b"))
    both = left.unionByName(right).groupBy(*keys).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    return both.fillna(0.0, ["__a", "__b"]).select(*keys, F.try_divide("__a", "__b").alias(out))


def attach_strata_weight(
    df: DataFrame, weights: DataFrame, keys: Sequence[str], weight: str, default: int = 0
) -> DataFrame:
    """The stratum's target size on every row, ``default`` for strata without one."""
    joined = lookup_join(df, weights.select(*keys, weight), keys)
    return joined.fillna(default, [weight]).select(*df.columns, weight)


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side are filled with NULL."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def union_marked(first: DataFrame, second: DataFrame, marker: str = "is_train") -> DataFrame:
    """Union that remembers which side a row came from."""
    return union_all(first.withColumn(marker, F.lit(True)), second.withColumn(marker, F.lit(False)))


def split_by_marker(df: DataFrame, marker: str = "is_train") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(marker)).drop(marker), df.filter(~F.col(marker)).drop(marker)
