"""Ordered computations without a single-task window.

Running totals, row numbers, quantiles and empirical distributions all need "everything before me in
sort order". A plain window over a global order (or over one hot group) lands in one task. Here rows
are cut into range buckets of about equal size first; a window runs inside each (group, bucket) chunk,
and the totals of earlier buckets come from a table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, work_partitions

BUCKET = "__bucket"
CHUNK = "__chunk"
QUANTILE_BUCKETS = 256
# Rows that one range bucket of a global order should hold.
BUCKET_ROWS = 4_000_000
# Rows of a task whose work on each is large.
SPREAD_ROWS = 100_000
# Buckets with wanted ranks: up to this many are broadcast, and up to this many rows of one meet in a window.
WANTED_CHUNKS = 20_000
WINDOW_ROWS = 4_000_000


def bucket_edges(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Approximate equal-mass cut points per column, from one mergeable sketch pass.

    Only the balance of the buckets depends on the sketch; results built on the buckets stay exact.
    """
    n = buckets or work_partitions(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    row = df.agg(
        *[F.percentile_approx(F.col(f"`{c}`").cast("double"), probs, 20 * n).alias(f"e{i}") for i, c in enumerate(cols)]
    ).first()
    return {
        c: sorted({v for v in (row[i] or []) if v == v and abs(v) != float("inf")}) for i, c in enumerate(cols)
    }


def assign_buckets(df: DataFrame, edges: Mapping[str, Sequence[float]], outputs: Mapping[str, str]) -> DataFrame:
    """Add a bucket number per column by binary search on the cut points, all columns in one projection."""
    infinite = float("inf")
    cutter = Bucketizer(
        splitsArray=[[-infinite, *(cuts or [0.0]), infinite] for cuts in edges.values()],
        inputCols=list(edges),
        outputCols=[outputs[c] for c in edges],
        handleInvalid="keep",
    )
    return cutter.transform(df)


def running_totals(
    df: DataFrame,
    order_by: str,
    totals: Mapping[str, Column],
    groups: Sequence[str] = (),
    ties: Sequence[str] = (),
    bucket: str | None = None,
    with_group_total: bool = False,
) -> DataFrame:
    """Add, per name in ``totals``, the inclusive running sum in ascending ``order_by`` inside each group.

    ``order_by`` (with ``ties``) must be unique per group; callers pre-aggregate equal values first, so a
    value that holds a third of the rows is one row here. ``bucket`` names a ready bucket column that is
    monotone in ``order_by``; otherwise one is cut. NULL group values form a group of their own.
    ``with_group_total`` also adds ``<name>_all``, the total of the whole group.
    """
    if bucket is None:
        bucketed = assign_buckets(df, bucket_edges(df, [order_by]), {order_by: BUCKET})
    else:
        bucketed = df.withColumn(BUCKET, F.col(bucket))
    weights = {f"__w{i}": expr for i, expr in enumerate(totals.values())}
    # a struct compares NULL group values as equal; without groups the bucket itself is the chunk
    parts = [F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(groups)]
    key = F.struct(*parts, F.col(BUCKET).alias("b")) if groups else F.col(BUCKET)
    chunked = bucketed.withColumn(CHUNK, key).withColumns(weights)

    sums = chunked.groupBy(CHUNK).agg(*[F.sum(w).alias(w) for w in weights])
    peers = [F.col(f"{CHUNK}.g{i}") for i in range(len(groups))] or [F.lit(1)]
    place = F.col(f"{CHUNK}.b") if groups else F.col(CHUNK)
    whole = Window.partitionBy(*peers)
    before = whole.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        CHUNK,
        *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_off") for w in weights],
        *([F.sum(w).over(whole).alias(f"{w}_all") for w in weights] if with_group_total else []),
    )
    inside = (
        Window.partitionBy(CHUNK)
        .orderBy(F.col(f"`{order_by}`"), *[F.col(f"`{t}`") for t in ties])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = chunked.withColumns({f"{w}_run": F.sum(w).over(inside) for w in weights})
    # without groups there is one offset row per bucket, a few thousand at most
    joined = local.join(offsets if groups else F.broadcast(offsets), CHUNK)
    keep = [F.col(f"`{c}`") for c in df.columns]
    added = [(F.col(f"{w}_run") + F.col(f"{w}_off")).alias(name) for w, name in zip(weights, totals)]
    if with_group_total:
        added += [F.col(f"{w}_all").alias(f"{name}_all") for w, name in zip(weights, totals)]
    return joined.select(*keep, *added)


def position_by(df: DataFrame, sort: Column, out: str, buckets: int | None = None) -> DataFrame:
    """1-based position of each row by a sort key of any orderable type; equal keys are numbered in some order.

    Rows are range-partitioned and written once; a row's position is its index in its partition plus the sizes of the
    partitions before it. The offsets have one row per partition.
    """
    n = buckets or max(work_partitions(df.sparkSession), df.count() // BUCKET_ROWS)
    keyed = df.withColumn("__sort", sort).repartitionByRange(n, "__sort").sortWithinPartitions("__sort")
    fixed = cut_lineage(keyed.drop("__sort").withColumn("__at", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("__part", F.shiftright("__at", 33))
    sizes = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    placed = fixed.join(F.broadcast(offsets), "__part")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(out))


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by ``key`` and written once, for work that is far larger than the bytes of a small file, which one task reads."""
    n = max(work_partitions(df.sparkSession), df.count() // SPREAD_ROWS)
    return cut_lineage(df.repartition(n, F.xxhash64(F.col(f"`{key}`"))))


def with_row_number(df: DataFrame, order_key: str, out: str = "row_number", groups: Sequence[str] = ()) -> DataFrame:
    """1-based row number by a unique numeric ``order_key`` (optionally inside groups), exact and distributed."""
    return running_totals(df, order_key, {out: F.lit(1).cast("long")}, groups)


def values_long(
    df: DataFrame, cols: Sequence[str], groups: Sequence[str], edges: Mapping[str, Sequence[float]]
) -> DataFrame:
    """``groups, column, value`` and the value's range bucket, for several columns in one scan; NULL and NaN dropped."""
    tagged = assign_buckets(df, edges, {c: f"__b_{i}" for i, c in enumerate(cols)})
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"), F.col(f"__b_{i}").alias(BUCKET)
        )
        for i, c in enumerate(cols)
    ]
    long = tagged.select(*[F.col(f"`{g}`") for g in groups], F.inline(F.array(*cells)))
    present = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return present.withColumn("value", F.col("value") + F.lit(0.0))  # -0.0 and 0.0 are one value


def value_positions(df: DataFrame, col: str) -> DataFrame:
    """``col, middle, n`` per distinct value: the mean of its ranks, and the number of rows. NULL and NaN have no rank."""
    long = values_long(df, [col], [], bucket_edges(df, [col]))
    points = long.groupBy("value", BUCKET).agg(F.count(F.lit(1)).alias("rows"))
    run = running_totals(points, "value", {"last": F.col("rows")}, bucket=BUCKET, with_group_total=True)
    middle = F.col("last") - (F.col("rows") - 1) / 2.0
    return run.select(F.col("value").alias(col), middle.alias("middle"), F.col("last_all").alias("n"))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles per (group, column): columns ``column``, ``n``, ``quantiles``.

    Counts per range bucket tell in which buckets the wanted ranks lie; only the values of those buckets are
    shuffled and ordered. The values of a group are never held together, unlike in the built-in percentile.
    """
    edges = bucket_edges(df, cols, QUANTILE_BUCKETS)
    key = F.struct(*[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate([*groups, "column"])], F.col(BUCKET).alias("b"))
    long = values_long(df, cols, groups, edges).withColumn(CHUNK, key)

    def spot(p: float, total: Column) -> Column:
        return (total - 1) * F.lit(float(p))

    peers = [F.col(f"{CHUNK}.g{i}") for i in range(len(groups) + 1)]
    before = Window.partitionBy(*peers).orderBy(F.col(f"{CHUNK}.b")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = long.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("rows"))
    chunks = chunks.withColumns(
        {
            "before": F.coalesce(F.sum("rows").over(before), F.lit(0)),
            "total": F.sum("rows").over(Window.partitionBy(*peers)),
        }
    )
    ranks = [side(spot(p, F.col("total"))) for p in probs for side in (F.floor, F.ceil)]
    inside = F.lit(False)
    for rank in ranks:
        inside = inside | ((rank >= F.col("before")) & (rank < F.col("before") + F.col("rows")))
    wanted = chunks.filter(inside)
    found = wanted.limit(WANTED_CHUNKS + 1).collect()
    few = len(found) <= WANTED_CHUNKS
    table = F.broadcast(df.sparkSession.createDataFrame(found, wanted.schema)) if few else wanted

    picked = long.join(table.select(CHUNK, "before", "total"), CHUNK)
    values = picked.groupBy(CHUNK, "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("before").alias("before"), F.max("total").alias("total")
    )
    if few and all(r["rows"] <= WINDOW_ROWS for r in found):
        upward = Window.partitionBy(CHUNK).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ordered = values.withColumn("run", F.sum("n").over(upward))
    else:
        renamed = values.withColumnRenamed(CHUNK, "chunk")
        ordered = running_totals(renamed, "value", {"run": F.col("n")}, ["chunk"]).withColumnRenamed("chunk", CHUNK)
    last = F.col("before") + F.col("run") - 1
    first = last - F.col("n") + 1
    picks = []
    for i, p in enumerate(probs):
        for name, side in (("lo", F.floor), ("hi", F.ceil)):
            rank = side(spot(p, F.col("total")))
            picks.append(F.max(F.when((rank >= first) & (rank <= last), F.col("value"))).alias(f"{name}{i}"))
    named = [p.alias(n) for p, n in zip(peers, [*groups, "column"])]
    rows = ordered.select(*named, "*").groupBy(*groups, "column").agg(F.max("total").alias("n"), *picks)
    quantiles = []
    for i, p in enumerate(probs):
        place, lo, hi = spot(p, F.col("n")), F.col(f"lo{i}"), F.col(f"hi{i}")
        quantiles.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place))))
    return rows.select(*groups, "column", "n", F.array(*quantiles).alias("quantiles"))


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows by descending ``by``; equal values in ascending order of ``ties``."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc() for t in ties]).limit(k)
