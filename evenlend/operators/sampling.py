"""Splits and exact-size samples. Every choice is a function of the key and a seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage
from .frequency import freq
from .joins import fits_broadcast, sample_by_ids, sample_by_rownum, union_all

SCORE_BITS = 32
BUCKET_BITS = 10  # at least; tables of over 2**30 rows get more slices, so that one holds about SLICE_ROWS rows
SLICE_ROWS = 1 << 20


def uniform_score(key: Column, seed: int = 0) -> Column:
    """Uniform 32-bit score of a key of any type."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 64 - SCORE_BITS)


def arithmetic_score(key: Column, seed: int = 0) -> Column:
    """32-bit score of an integer key from plain arithmetic, reproducible in any SQL engine."""
    half = F.pmod(key.cast("bigint") + F.lit(seed), F.lit(2147483648))
    return F.pmod(half * F.lit(2654435761), F.lit(4294967296))


def split_by_ids(df: DataFrame, train_ids: DataFrame, test_ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return sample_by_ids(df, train_ids, key), sample_by_ids(df, test_ids, key)


def split_by_hash(df: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Bernoulli split that depends only on the key, so it is stable across runs and tables."""
    cut = int(share * 2**SCORE_BITS)
    score = uniform_score(F.col(key), seed)
    return df.filter(score < cut), df.filter(score >= cut)


def stratified_exact(
    df: DataFrame,
    strata: Sequence[str],
    sizes: DataFrame,
    key: str | Sequence[str],
    size_col: str = "size",
    score: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """Exactly ``size`` rows per stratum without replacement (all rows when the stratum is smaller).

    The sample is the ``size`` lowest scores, ties in the order of the ``key`` column or columns. Scores are cut into equal slices, 1,024 or more as the table grows; counts per
    (stratum, slice) tell which slices are taken whole, which one is taken in part and which not at all. Whole slices
    need only a lookup, and a ranking window runs on the one partial slice per stratum, so a stratum that
    holds a third of the table never meets in one task.
    """
    names, keys = list(strata), [key] if isinstance(key, str) else list(key)
    score = uniform_score(F.struct(*keys) if len(keys) > 1 else F.col(keys[0]), seed) if score is None else score
    bits = min(SCORE_BITS, max(BUCKET_BITS, (df.count() // SLICE_ROWS).bit_length()))
    shift = SCORE_BITS - bits
    scored = df.withColumn("__score", score).withColumn("__slice", F.shiftright(F.col("__score"), shift))

    counts = scored.dropna(subset=names).groupBy(*names, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*names).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .join(sizes.select(*names, F.col(size_col).cast("bigint").alias("__size")), names)
        .filter(F.col("__before") < F.col("__size"))
        .select(*names, "__slice", (F.col("__size") - F.col("__before")).alias("__need"), "__n")
    )
    plan = cut_lineage(plan)
    side = F.broadcast(plan) if fits_broadcast(plan) else plan
    picked = scored.join(side, [*names, "__slice"])
    whole = picked.filter(F.col("__n") <= F.col("__need"))
    rank = F.row_number().over(Window.partitionBy(*names, "__slice").orderBy("__score", *keys))
    part = picked.filter(F.col("__n") > F.col("__need")).withColumn("__rank", rank).filter("__rank <= __need")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return whole.select(*columns).union(part.select(*columns))


def _size_table(df: DataFrame, group: str, sizes: Mapping[object, int]) -> DataFrame:
    schema = T.StructType([df.schema[group], T.StructField("size", T.LongType())])
    return df.sparkSession.createDataFrame([(g, int(n)) for g, n in sizes.items()], schema)


def undersample(
    df: DataFrame, group: str, sizes: Mapping[object, int], key: str, score: Column | None = None, seed: int = 0
) -> DataFrame:
    """Groups named in ``sizes`` are cut to that many rows; all other rows are kept."""
    listed = F.col(group).isin(*sizes)
    cut = stratified_exact(df.filter(listed), [group], _size_table(df, group, sizes), key, score=score, seed=seed)
    return df.filter(~F.coalesce(listed, F.lit(False))).unionByName(cut)


def rebalance(df: DataFrame, group: str, key: str, score: Column | None = None, seed: int = 0) -> DataFrame:
    """Every group cut to the size of the smallest one."""
    counts = freq(df, group, dropna=True)
    smallest = counts.agg(F.min("n")).scalar()
    return stratified_exact(df, [group], counts.select(group, smallest.alias("size")), key, score=score, seed=seed)


def rebalance_collect(
    df: DataFrame,
    group: str,
    protected: object,
    majority: object,
    minority_size: int,
    extra_size: int,
    key: str,
    score: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """The minority sample grown by ``extra_size`` further protected rows, with as many majority rows.

    Scores are nested: the first ``minority_size`` protected rows are the ones :func:`undersample` takes.
    """
    n = minority_size + extra_size
    both = df.filter(F.col(group).isin(protected, majority))
    sizes = _size_table(df, group, {protected: n, majority: n})
    return stratified_exact(both, [group], sizes, key, score=score, seed=seed)


def rebalance_by_rownum(
    df: DataFrame, group: str, lists: Mapping[object, DataFrame], order_key: str, id_col: str = "row_number"
) -> DataFrame:
    """Saved lists of row numbers, one per group, applied to the group's rows in key order."""
    return union_all(
        *[sample_by_rownum(df.filter(F.col(group) == F.lit(g)), ids, order_key, id_col) for g, ids in lists.items()]
    )


def blind(df: DataFrame, *attrs: str) -> DataFrame:
    """The table without the protected attribute."""
    return df.drop(*attrs)
