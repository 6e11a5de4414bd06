"""Level lists, encodings, relabelling, merging and dummy columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.missing import quoted
from ..functions.scalars import locale_key
from ..session import LEVEL_CAP
from .columns import map_columns
from .joins import salted_join
from .ordering import position_by

POSITION_LEVELS = 256


def label_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, level, n`` for several columns in one scan; a missing value is the NULL level."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in cols]
    return df.select(F.inline(F.array(*cells))).groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def driver_levels(df: DataFrame, cols: Sequence[str], cap: int = LEVEL_CAP) -> dict[str, list[tuple[str, int]]] | None:
    """Levels with counts in locale order, per column; None when all columns together exceed ``cap`` levels."""
    counts = label_counts(df, cols).withColumn("folded", F.lower("level"))
    rows = counts.limit(cap + 1).collect()
    if len(rows) > cap:
        return None
    out: dict[str, list] = {c: [] for c in cols}
    for r in sorted(rows, key=lambda r: (r["folded"] is None, r["folded"] or "", r["level"] or "")):
        out[r["column"]].append((r["level"], r["n"]))
    return out


def closed_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """Levels with counts where each level becomes a column of the result, so that the schema holds them anyway."""
    return ranked_levels(label_counts(df, cols), cols)


def ranked_levels(counts: DataFrame, cols: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """All of ``label_counts`` in locale order, per column."""
    out: dict[str, list] = {c: [] for c in cols}
    for r in sorted(counts.withColumn("folded", F.lower("level")).collect(), key=lambda r: (r["folded"] is None, r["folded"] or "", r["level"] or "")):
        out[r["column"]].append((r["level"], r["n"]))
    return out


def levels_by_freq(df: DataFrame, col: str) -> DataFrame:
    """``level, n, ord``: most frequent level first, equal counts in locale order; level 1 is the reference."""
    counts = df.groupBy(F.col(col).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n")).dropna(subset=["level"])
    return _ordered(counts, F.struct((-F.col("n")).alias("neg"), F.lower("level").alias("folded"), F.col("level").alias("exact")))


def levels_sorted(df: DataFrame, col: str) -> DataFrame:
    """``level, ord`` in case-insensitive order."""
    levels = df.select(F.col(col).cast("string").alias("level")).dropna().distinct()
    return _ordered(levels, locale_key(F.col("level")))


def _ordered(levels: DataFrame, sort: Column, cap: int = LEVEL_CAP) -> DataFrame:
    rows = levels.withColumn("__sort", sort).limit(cap + 1).collect()
    if len(rows) > cap:
        return position_by(levels, sort, "ord").withColumn("ord", F.col("ord").cast("int"))
    ranked = sorted(rows, key=lambda r: tuple(r["__sort"]))
    schema = T.StructType([*levels.schema.fields, T.StructField("ord", T.IntegerType())])
    names = levels.columns
    return levels.sparkSession.createDataFrame(
        [(*[r[c] for c in names], i + 1) for i, r in enumerate(ranked)], schema
    )


def code_table(df: DataFrame, col: str) -> DataFrame:
    """``col, code`` for a column with too many levels for the driver, built without a global window."""
    levels = df.select(F.col(f"`{col}`").alias(col)).dropna().distinct()
    return position_by(levels, locale_key(F.col(f"`{col}`").cast("string")), "__code")


def encode_sorted(df: DataFrame, cols: Sequence[str], cap: int = LEVEL_CAP) -> DataFrame:
    """Labels to 1-based integer codes in locale order of the levels; missing stays missing.

    Short level lists become a literal lookup inside the projection, longer ones a counted broadcast
    join, and columns beyond the driver cap a salted join with a distributed code table.
    """
    cols = list(cols)
    if not cols:
        return df
    found = driver_levels(df, cols, cap)
    if found is None:
        sizes = label_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("n")).orderBy("n").collect()
        short, total = [], 0
        for r in sizes:
            total += r["n"]
            if total <= cap:
                short.append(r["column"])
        found = driver_levels(df, short, cap) if short else {}
    order = df.columns
    exprs: dict[str, Column] = {}
    out = df
    for i, c in enumerate(cols):
        levels = [v for v, _ in found[c] if v is not None] if c in found else None
        if levels is not None and len(levels) <= POSITION_LEVELS:
            known = F.array(*[F.lit(v) for v in levels]) if levels else F.array(F.lit(""))
            exprs[c] = F.array_position(known, F.col(f"`{c}`").cast("string")).cast("int")
            continue
        code = f"__code_{i}"
        if levels is not None:
            table = df.sparkSession.createDataFrame(
                [(v, k + 1) for k, v in enumerate(levels)], f"`{c}` string, `{code}` int"
            )
            out = out.join(F.broadcast(table), c, "left")
        else:
            table = code_table(df, c).withColumnRenamed("__code", code)
            out = salted_join(out, table, [c], "left")
        exprs[c] = F.col(code).cast("int")
    return out.select(*[exprs[c].alias(c) if c in exprs else F.col(f"`{c}`") for c in order])


def relabel(df: DataFrame, col: str, labels: Sequence[str | None]) -> DataFrame:
    """Give the sorted levels of a column new names by position; a None label makes that level missing."""
    kind = df.schema[col].dataType.typeName()
    rows = df.select(F.col(col)).dropna().distinct().limit(len(labels) + 1).collect()
    values = [r[0] for r in rows]
    if len(values) > len(labels):
        raise ValueError(f"{col} has more levels than the {len(labels)} labels given")
    if kind == "string":  # the order of all label columns is that of the engine's lower-casing
        folded = df.select(F.col(col).alias("v"), F.lower(F.col(col)).alias("f")).dropna().distinct().collect()
        order = {r["v"]: r["f"] for r in folded}
        values.sort(key=lambda v: (order[v], v))
    else:
        values.sort()
    mapped = F.lit(None).cast("string")
    for value, label in zip(values, labels):
        mapped = F.when(F.col(col) == F.lit(value), F.lit(label).cast("string")).otherwise(mapped)
    return df.withColumn(col, mapped)


def relabel_codes(df: DataFrame, col: str, labels: Sequence[str | None]) -> DataFrame:
    """Names for codes 1, 2, ...: code k becomes label k, whatever codes are present; other codes become missing."""
    code = F.col(f"`{col}`").cast("int")
    names = F.array(*[F.lit(v).cast("string") for v in labels])
    return df.withColumn(col, F.when(code.between(1, len(labels)), F.get(names, code - 1)))


def merge_levels(df: DataFrame, col: str, levels: Sequence[object], label: str) -> DataFrame:
    """Fold the listed levels into ``label``; the others stay."""
    c = F.col(col).cast("string")
    return df.withColumn(col, F.when(c.isin(*[str(v) for v in levels]), F.lit(label)).otherwise(c))


def collapse_expr(c: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    out = c
    for new, old in groups.items():
        out = F.when(c.isin(*old), F.lit(new)).otherwise(out)
    return out


def collapse_levels(df: DataFrame, col: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Fold several label lists into one new label each; the others stay."""
    return df.withColumn(col, collapse_expr(F.col(col), groups))


def text_literal(value: str) -> str:
    """A string for SQL text, quotes and backslashes escaped."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def explicit_na(df: DataFrame, cols: Sequence[str], label: str = "0") -> DataFrame:
    wanted, shown = set(cols), text_literal(label)
    return df.selectExpr(
        *[
            f"coalesce(string({quoted(c)}), {shown}) AS {quoted(c)}" if c in wanted else quoted(c)
            for c in df.columns
        ]
    )


def ints_to_labels(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Integer columns become label columns; keys are named in ``exclude``."""
    return map_columns(
        df,
        lambda f: f.dataType.typeName() in ("integer", "long", "short", "byte") and f.name not in exclude,
        lambda c: c.cast("string"),
    )


def dummies(
    df: DataFrame, cols: Sequence[str], drop: str | None = "most_frequent", na: str = "column", remove: bool = True
) -> DataFrame:
    """0/1 columns ``<col>_<level>``, without the most frequent level, plus ``<col>_NA`` where values are missing.

    In rows with a missing source the level columns are NULL and only ``<col>_NA`` is 1.
    """
    found = closed_levels(df, cols)
    out = [quoted(c) for c in df.columns if not (remove and c in set(cols))]
    for c in dict.fromkeys(cols):
        levels = [(v, n) for v, n in found[c] if v is not None]
        common = max(levels, key=lambda x: x[1])[0] if levels and drop == "most_frequent" else None
        source = quoted(c)
        for v, _ in levels:
            if v != common:
                test = f"string({source}) = {text_literal(v)}"
                out.append(f"CASE WHEN {test} THEN 1 WHEN {source} IS NOT NULL THEN 0 END AS {quoted(f'{c}_{v}')}")
        if na == "column" and any(v is None for v, _ in found[c]):
            out.append(f"CASE WHEN {source} IS NULL THEN 1 ELSE 0 END AS {quoted(f'{c}_NA')}")
    return df.selectExpr(*out)


def dummies_long(df: DataFrame, key: Sequence[str], cols: Sequence[str], drop: str | None = "most_frequent") -> DataFrame:
    """``key..., column, level``: the ones of all dummy columns, one row each, for columns of any number of levels.

    Levels stay a table. The most frequent level of a column (the first in sorted order among equals) is the reference and
    has no row; a missing value has the NULL level.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in dict.fromkeys(cols)]
    ones = df.select(*[F.col(f"`{k}`") for k in key], F.inline(F.array(*cells)))
    if drop != "most_frequent":
        return ones
    known = label_counts(df, list(dict.fromkeys(cols))).filter("level IS NOT NULL")
    rank = F.struct((-F.col("n")).alias("n"), locale_key(F.col("level")))
    common = known.groupBy("column").agg(F.min_by("level", rank).alias("__common"))  # one row per named column
    return ones.join(F.broadcast(common), "column", "left").filter("level IS NULL OR level <> __common").select(*key, "column", "level")
