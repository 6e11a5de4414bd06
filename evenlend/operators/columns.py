"""Column selection, projection and filter operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T


def drop_cols(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_features(df: DataFrame, names: Sequence[str], label: str | None = None) -> DataFrame:
    """Exactly the listed features, in order, with the label last."""
    return df.select(*[F.col(f"`{n}`") for n in names], *([F.col(f"`{label}`")] if label else []))


def names_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def names_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def select_prefix(df: DataFrame, *prefixes: str, also: Sequence[str] = ()) -> DataFrame:
    picked = [c for p in prefixes for c in names_with_prefix(df, p)]
    return select_features(df, list(dict.fromkeys([*picked, *also])))


def select_regex(df: DataFrame, pattern: str, also: Sequence[str] = ()) -> DataFrame:
    return select_features(df, list(dict.fromkeys([*names_matching(df, pattern), *also])))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def columns_of_type(df: DataFrame, *kinds: type[T.DataType], exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude]


def map_columns(
    df: DataFrame, which: Sequence[str] | Callable[[T.StructField], bool], fn: Callable[[Column], Column]
) -> DataFrame:
    """Apply ``fn`` to the named columns, or to those whose field satisfies a predicate, in one projection."""
    chosen = {f.name for f in df.schema.fields if which(f)} if callable(which) else set(which)
    return df.select(
        *[fn(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns]
    )


def with_features(df: DataFrame, features: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add derived columns in order; a later one may use an earlier one.

    Consecutive columns that do not depend on each other's names share one projection.
    """
    layer: dict[str, Column] = {}
    for name, expr in features:
        text = str(expr)
        if name in layer or any(re.search(rf"\b{re.escape(done)}\b", text) for done in layer):
            df = df.withColumns(layer)
            layer = {}
        layer[name] = expr
    return df.withColumns(layer) if layer else df


def with_constant(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def assemble(df: DataFrame, names: Sequence[str], out: str = "features", invalid: str = "keep") -> DataFrame:
    """Numeric columns as one vector column; missing values become NaN unless ``invalid`` says otherwise."""
    return VectorAssembler(inputCols=list(names), outputCol=out, handleInvalid=invalid).transform(df)


def unpivot_columns(
    df: DataFrame, key: str | Sequence[str], names: Sequence[str], name_col: str = "feature", value_col: str = "value"
) -> DataFrame:
    """Wide to long; missing values keep their rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.unpivot(keys, list(names), name_col, value_col)


def filter_any_match(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    return df.filter(F.col(col).isin(*values))


def filter_not_equal(df: DataFrame, col: str, value: object) -> DataFrame:
    """Rows different from ``value``; rows with a missing value are dropped too."""
    return df.filter(F.col(col) != F.lit(value))


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(names))


def argmax_rows(df: DataFrame, col: str) -> DataFrame:
    """All rows that reach the maximum; the maximum is a scalar subquery, so no join is planned."""
    return df.filter(F.col(col) == df.agg(F.max(col)).scalar())
