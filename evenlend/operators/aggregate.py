"""Grouped summaries and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.missing import FLOATING, quoted
from .categorical import encode_sorted
from .columns import columns_of_type
from .joins import left_attach, lookup_join
from .ordering import exact_quantiles

SIX = ("mean", "sd", "min", "max", "sum", "n_distinct")
# Largest group (rows x summarised columns) whose values may sit together in one task's memory.
GROUP_CELLS = 200_000
HOT_KEYS = 100_000


def _value(field: T.StructField) -> str:
    c = quoted(field.name)
    if isinstance(field.dataType, FLOATING):
        return f"CASE WHEN NOT isnan({c}) THEN {c} + 0.0D END"  # NaN is missing; -0.0 and 0.0 are one value
    return f"double({c})" if isinstance(field.dataType, T.DecimalType) else c


def _counted(field: T.StructField, digits: int | None) -> str:
    """The value whose distinct values are counted; inexact ones to ``digits`` significant digits."""
    v = _value(field)
    if digits is None or not isinstance(field.dataType, FLOATING):
        return v
    unit = f"power(10.0D, floor(log10(abs({v}))) - {digits - 1})"
    return f"CASE WHEN {v} = 0.0D OR abs({v}) = double('Infinity') THEN {v} ELSE round({v} / {unit}) * {unit} END"


def _summaries(
    fields: Sequence[T.StructField], stats: Sequence[str], hot: bool, infinite_empty: bool, digits: int | None = None
) -> list[Column]:
    """One aggregate per field and statistic, in SQL text."""
    forms = {
        "mean": "avg({v})",
        "sd": "stddev_samp({v})",
        "min": "coalesce(double(min({v})), double('Infinity'))" if infinite_empty else "double(min({v}))",
        "max": "coalesce(double(max({v})), double('-Infinity'))" if infinite_empty else "double(max({v}))",
        "sum": "coalesce(sum(double({v})), 0.0D)",
        "n_distinct": "int(count(DISTINCT {v}))" if hot else "size(array_distinct(collect_list({v})))",
    }
    out = []
    for f in fields:
        value = _value(f)
        inexact = digits if f.name.endswith(("_mean", "_sd")) else None
        for s in stats:
            v = _counted(f, inexact) if s == "n_distinct" else value
            out.append(F.expr(f"{forms[s].format(v=v)} AS {quoted(f'{f.name}_{s}')}"))
    return out


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int, cap: int = HOT_KEYS) -> list | None:
    """Keys with more than ``max_rows`` rows, a list bounded by ``cap``; None when there are more."""
    heavy = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_rows).select(*keys)
    rows = heavy.limit(cap + 1).collect()
    return None if len(rows) > cap else rows


def _is_hot(df: DataFrame, hot: list, keys: Sequence[str], how: str) -> DataFrame:
    marked = df.sparkSession.createDataFrame(hot, df.select(*keys).schema).toDF(*[f"__h{i}" for i in range(len(keys))])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__h{i}"))
    return df.join(F.broadcast(marked), cond, how)


def summarise_all(
    df: DataFrame,
    key: str | Sequence[str],
    stats: Sequence[str] = SIX,
    cols: Sequence[str] | None = None,
    counts_from: DataFrame | None = None,
    group_cells: int = GROUP_CELLS,
    infinite_empty: bool = False,
    counted_digits: int | None = None,
) -> DataFrame:
    """Per key, every statistic of every other numeric column, missing values left out: ``<col>_<stat>``.

    Empty groups give sum 0 and n_distinct 0; infinities are kept, so they show in mean, sum and max.
    Rows of ordinary keys are shuffled once, raw: with few rows per key and map task a row is much smaller
    than its partial aggregate. Their distinct counts come from the group's values in memory. Keys with more
    rows than ``group_cells / columns`` are found first by a count and go through a distinct aggregate with
    map-side combining, which spreads their values over all tasks. ``counts_from`` may name a cheaper table
    with the same rows per key (for example the child before it was joined). ``infinite_empty`` gives an
    empty group the minimum +Infinity and maximum -Infinity instead of NULL. With ``counted_digits`` the distinct
    values of earlier means and deviations are told apart by that many significant digits.
    """
    keys = [key] if isinstance(key, str) else list(key)
    numeric = {f.name: f for f in df.schema.fields if isinstance(f.dataType, (T.NumericType,)) and f.name not in keys}
    fields = list(numeric.values()) if cols is None else [numeric[c] for c in cols]
    used = df.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{f.name}`") for f in fields])
    if "n_distinct" not in stats:
        return used.groupBy(*keys).agg(*_summaries(fields, stats, False, infinite_empty, counted_digits))

    limit = max(1, group_cells // max(1, len(fields)))
    heavy = hot_keys(counts_from if counts_from is not None else df, keys, limit)
    if heavy is None:
        return used.groupBy(*keys).agg(*_summaries(fields, stats, True, infinite_empty, counted_digits))
    by_group = _summaries(fields, stats, False, infinite_empty, counted_digits)
    if not heavy:
        return used.repartition(*keys).groupBy(*keys).agg(*by_group)
    cold = _is_hot(used, heavy, keys, "left_anti").repartition(*keys).groupBy(*keys).agg(*by_group)
    by_expand = _summaries(fields, stats, True, infinite_empty, counted_digits)
    warm = _is_hot(used, heavy, keys, "left_semi").groupBy(*keys).agg(*by_expand)
    return cold.unionByName(warm)


def encode_and_summarise(
    df: DataFrame, key: str, drop: Sequence[str] = (), stats: Sequence[str] = SIX, **options: object
) -> DataFrame:
    """Drop foreign keys, turn labels into codes, then summarise every column per key."""
    kept = df.drop(*drop)
    coded = encode_sorted(kept, columns_of_type(kept, T.StringType, exclude=[key]))
    return summarise_all(coded, key, stats, counts_from=kept, **options)


def summarise_nested(
    grand: DataFrame,
    child: DataFrame,
    child_key: str,
    parent_key: str,
    stats: Sequence[str] = SIX,
    infinite_empty: bool = False,
    counted_digits: int = 12,
) -> DataFrame:
    """Grandchild rows summarised per child, attached to the child, then summarised again per parent.

    The last bits of a distributed sum depend on the order of its parts, and the outer distinct counts must not: inner
    means and deviations are counted by ``counted_digits`` significant digits, all other statistics use them as they are.
    """
    inner = encode_and_summarise(grand, child_key, stats=stats, infinite_empty=infinite_empty)
    coded = encode_sorted(child, columns_of_type(child, T.StringType, exclude=[child_key, parent_key]))
    wide = left_attach(coded, inner, child_key).drop(child_key)
    return summarise_all(
        wide, parent_key, stats, counts_from=child, infinite_empty=infinite_empty, counted_digits=counted_digits
    )


def group_median(df: DataFrame, key: str, col: str, na_rm: bool = False, out: str = "median") -> DataFrame:
    """Exact median per key. With ``na_rm=False`` a group with a missing value has no median."""
    medians = exact_quantiles(df, [col], [0.5], [key])
    if na_rm:
        return medians.select(key, F.get("quantiles", F.lit(0)).alias(out))
    rows = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"))
    joined = rows.join(medians, rows["__key"].eqNullSafe(medians[key]), "left")
    return joined.select(
        F.col("__key").alias(key),
        F.when(F.col("__rows") == F.col("n"), F.get("quantiles", F.lit(0))).alias(out),
    )


def encode_by_group_stat(df: DataFrame, key: str, col: str, out: str, stat: str = "median") -> DataFrame:
    """The key's group statistic of ``col`` as a new column; a missing key has none."""
    if stat == "median":
        table = group_median(df, key, col, out=out)
    else:
        table = summarise_all(df, key, [stat], [col]).withColumnRenamed(f"{col}_{stat}", out)
    return lookup_join(df, table.filter(F.col(key).isNotNull()), key).select(*df.columns, out)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``column, n_missing`` (NULL or NaN) for every column, one pass."""
    fields = [f for f in df.schema.fields if cols is None or f.name in set(cols)]

    def missing(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return c.isNull() | F.isnan(c) if isinstance(f.dataType, FLOATING) else c.isNull()

    row = df.agg(*[F.count_if(missing(f)).alias(f"n{i}") for i, f in enumerate(fields)])
    cells = [F.struct(F.lit(f.name).alias("column"), F.col(f"n{i}").alias("n_missing")) for i, f in enumerate(fields)]
    return row.select(F.inline(F.array(*cells)))


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, n, n_missing, min, q1, median, mean, q3, max`` of numeric columns."""
    row = df.agg(
        *[
            agg(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))).alias(f"{name}{i}")
            for i, c in enumerate(cols)
            for name, agg in (("n", F.count), ("lo", F.min), ("mean", F.avg), ("hi", F.max))
        ],
        F.count(F.lit(1)).alias("rows"),
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("n"),
            (F.col("rows") - F.col(f"n{i}")).alias("n_missing"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"mean{i}").alias("mean"),
            F.col(f"hi{i}").alias("max"),
        )
        for i, c in enumerate(cols)
    ]
    base = row.select(F.inline(F.array(*cells)))
    quarters = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).select(
        "column", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    )
    return base.join(quarters, "column", "left").select(
        "column", "n", "n_missing", "min", "q1", "median", "mean", "q3", "max"
    )


def label_profile(df: DataFrame, cols: Sequence[str], top: int = 6) -> DataFrame:
    """``column, place, level, n`` of label columns: the ``top`` most frequent labels in order, then the others together.

    The last row of a column is ``(Other)``, with the number of rows of the remaining labels if there are any; missing values are
    the label ``(Missing)``. All columns are counted in one pass; a column keeps its best labels by an aggregate with
    map-side combining, so a column of any number of labels needs no window and no single task.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("(Missing)")).alias("level")) for c in cols]
    counts = df.select(F.inline(F.array(*cells))).groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    # The smallest (-n, level) pairs of slices of labels, then of the slices together.
    pair = F.struct((-F.col("n")).alias("less"), "level")
    sliced = counts.select("column", F.pmod(F.xxhash64("level"), F.lit(64)).alias("slice"), pair.alias("pair"), "n")
    few = sliced.withColumn("r", F.row_number().over(Window.partitionBy("column", "slice").orderBy("pair"))).filter(F.col("r") <= top)
    best = few.groupBy("column").agg(F.slice(F.array_sort(F.collect_list("pair")), 1, top).alias("best"))
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    joined = best.join(total, "column")
    held = -F.aggregate("best", F.lit(0).cast("bigint"), lambda a, x: a + x["less"])
    shown = F.transform("best", lambda x, i: F.struct((i + 1).alias("place"), x["level"].alias("level"), (-x["less"]).alias("n")))
    rest = F.struct((F.size("best") + 1).alias("place"), F.lit("(Other)").alias("level"), (F.col("total") - held).alias("n"))
    rows = F.when(F.col("total") > held, F.concat(shown, F.array(rest))).otherwise(shown)
    return joined.select("column", F.inline(rows))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, n_distinct`` without missing values; equal values collapse before they are counted."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols]
    values = df.select(F.inline(F.array(*cells))).dropna(subset=["v"]).distinct()
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
