"""Operator 4: exact top-k by inner product through a pivot-distance index.

Inner products become distances: with ``M`` the largest norm, a vector gets one more component ``sqrt(M^2 - |x|^2)`` and a
query a zero, so that ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x`` and the nearest vectors are those with the largest products.

Index: pivots are vectors taken by a hash, as many as the square root of the rows (``PIVOTS`` at least). Every vector is keyed by its
nearest pivot and the distance to it, cut into annuli of equal width. An annulus of more than ``CELL_ROWS`` vectors is dealt into
parts by a hash, so that one hot vector is no one task's load.

Search: a first bound on each query's k-th distance comes from a bounded sample (``PROBE``). The triangle inequality says
that a vector of annulus [lo, hi] of pivot p is at least ``max(lo - d(q,p), d(q,p) - hi, 0)`` away. Annuli are expanded in
rings: first the ones within a third of the bound, which tightens it, then those that still can hold a better vector.
Inside a cell vectors are sorted by pivot distance, and each query reads only the slice that its bound allows; products are compared
exactly, as integers. Queries meet cells through an equi-join on the cell, in blocks of ``QUERY_ROWS``; a cell's vectors are copied to
the blocks that hold a query which reaches it, to no others.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, neither do rows with a null id;
shorter vectors count as padded by zeros; repeated rows of one id and vector count once; a query never meets rows with its
own id; vectors of one id that differ are queries and candidates each; ties go to the smaller id; fewer than k candidates give fewer rows. Products are exact while they fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage, small_side

SCALE = 1024
PIVOTS = 32
PROBE = 2048
CELL_ROWS = 2048
RINGS = 16
QUERY_ROWS = 4096
CHUNK = 512  # queries whose products are computed together
REACH_CELLS = 1 << 20  # pairs of a query and an annulus whose bounds are looked at together
WIDTH_PIVOTS = 1024  # pivots whose distances give the width of the annuli
SLACK = 1e-9  # relative; distances are floating-point, the bounds give them room


@dataclass(frozen=True)
class Space:
    dims: int
    norm2: float  # the largest squared norm
    pivots: np.ndarray  # with the added component
    width: float  # of an annulus

    def lift(self, x: np.ndarray) -> np.ndarray:
        f = x.astype(np.float64)
        return np.hstack([f, np.sqrt(np.maximum(self.norm2 - (f * f).sum(axis=1), 0))[:, None]])

    def to_pivots(self, lifted: np.ndarray) -> np.ndarray:
        d2 = (lifted * lifted).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))

    def distance2(self, products: np.ndarray, query_norm2: np.ndarray) -> np.ndarray:
        return np.maximum(query_norm2 + self.norm2 - 2.0 * products, 0)


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: integer components ``floor(SCALE * x)`` of the rows that take part, each once."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine)
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("v")).distinct()


def _packed(v: Column, dims: int) -> Column:
    """Components padded to ``dims``, as an array of longs."""
    return F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(v)))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), dims)


def _sample(rows: DataFrame, n: int, seed: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` rows with the smallest hashes: a bounded number reaches the driver."""
    got = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n).toPandas()
    return got["vec_id"].to_numpy(np.int64), _matrix(got["v"], dims)


def pivot_count(rows: int) -> int:
    """Pivots of an index of ``rows`` vectors: both they and the vectors of one grow with the square root."""
    return max(PIVOTS, math.isqrt(rows))


def build_space(rows: DataFrame, pivots: int | None = None) -> Space | None:
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = rows.agg(F.max(F.size("v")).alias("dims"), F.max(square).alias("norm2"), F.count(F.lit(1)).alias("n")).first()
    if top["dims"] is None:
        return None
    padded = rows.select("vec_id", _packed(F.col("v"), top["dims"]).alias("v"))
    _, picked = _sample(padded, pivots or pivot_count(top["n"]), 1, top["dims"])
    bare = Space(top["dims"], float(top["norm2"]), np.zeros((0, top["dims"] + 1)), 1.0)
    lifted = np.unique(bare.lift(picked), axis=0)
    space = Space(bare.dims, bare.norm2, lifted, 1.0)
    between = space.to_pivots(lifted[:WIDTH_PIVOTS])
    return Space(bare.dims, bare.norm2, lifted, max(float(between.max()), 1.0) / RINGS)


def _index(rows: DataFrame, space: Space) -> DataFrame:
    """``vec_id, v, pivot, dist, ring, part, parts``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                d = space.to_pivots(space.lift(_matrix(frame["v"], space.dims)))
                near = d.argmin(axis=1)
                dist = d[np.arange(len(d)), near]
                yield frame.assign(pivot=near.astype(np.int32), dist=dist, ring=(dist // space.width).astype(np.int32))

    keyed = cut_lineage(rows.mapInPandas(run, "vec_id bigint, v array<bigint>, pivot int, dist double, ring int"))
    cells = keyed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"))
    cells = cut_lineage(cells.select("pivot", "ring", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")))
    placed = keyed.join(small_side(cells), ["pivot", "ring"])
    return placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))


def _best(scores: np.ndarray, out: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of every column of ``scores`` but those marked ``out``, ties to the smaller id."""
    n = len(scores)
    scores = np.where(out, scores.min() - 1, scores)
    least = np.partition(scores, n - k, axis=0)[n - k] if n > k else scores.min()
    row, col = np.nonzero((scores >= least) & ~out)
    order = np.lexsort((ids[row], -scores[row, col], col))
    row, col = row[order], col[order]
    first = np.searchsorted(col, col)
    keep = np.arange(len(col)) - first < k
    return row[keep], col[keep]


def _probe(queries: DataFrame, space: Space, ids: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """Adds the squared distance of the k-th best of the sample (infinite if the sample is too small), and the query's block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            q = _matrix(frame["v"], space.dims)
            scores = q @ sample.T
            d2 = space.distance2(scores, (q.astype(np.float64) ** 2).sum(1)[:, None])
            d2[frame["vec_id"].to_numpy()[:, None] == ids[None, :]] = np.inf
            bound = np.sort(d2, axis=1)[:, k - 1] if d2.shape[1] >= k else np.full(len(q), np.inf)
            yield frame.assign(bound=bound)

    return queries.mapInPandas(run, "vec_id bigint, v array<bigint>, bound double")


def _reach(queries: DataFrame, space: Space, share: float, beyond: float) -> DataFrame:
    """``place, pivot, ring`` of the annuli within ``share`` of the bound, but not those within ``beyond`` of ``old``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Vectors lie on the sphere of radius sqrt(norm2), so no pivot distance exceeds its diameter.
        rings = int(2 * np.sqrt(space.norm2) // space.width) + 2
        chunk = max(1, REACH_CELLS // (rings * len(space.pivots)))
        lo = np.arange(rings) * space.width
        for frame in (part.iloc[i : i + chunk] for part in frames for i in range(0, len(part), chunk)):
            d = space.to_pivots(np.hstack([_matrix(frame["v"], space.dims).astype(np.float64), np.zeros((len(frame), 1))]))
            radius = np.sqrt(frame["bound"].to_numpy()) * (1 + SLACK)
            done = np.sqrt(frame["old"].to_numpy()) * (1 + SLACK) * beyond
            away = np.maximum(np.maximum(lo[None, None, :] - d[:, :, None], d[:, :, None] - lo[None, None, :] - space.width), 0)
            q, p, r = np.nonzero((away <= (radius * share)[:, None, None]) & ((away > done[:, None, None]) | (beyond == 0)))
            yield pd.DataFrame({"place": frame["place"].to_numpy()[q], "pivot": p.astype(np.int32), "ring": r.astype(np.int32)})

    return queries.mapInPandas(run, "place bigint, pivot int, ring int")


def asked_cells(reach: DataFrame, index: DataFrame, blocks: int) -> DataFrame:
    """``place, pivot, ring, part, block``: the parts of cells that exist and are reached, with the block of the query."""
    parts = cut_lineage(index.select("pivot", "ring", "parts").distinct())
    asked = reach.join(small_side(parts), ["pivot", "ring"])
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return cut_lineage(asked.withColumn("block", F.pmod(F.xxhash64("place", F.lit(3)), F.lit(blocks)).cast("int")))


def held_cells(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The index rows of the asked cells, once for every block that asks."""
    wanted = cut_lineage(asked.select(*[F.col(c).alias(c) for c in ("pivot", "ring", "part", "block")]).distinct())
    return index.join(small_side(wanted), ["pivot", "ring", "part"])


def _expand(queries: DataFrame, reach: DataFrame, index: DataFrame, space: Space, k: int, blocks: int) -> DataFrame:
    """The k best of every query in each reached cell."""
    asked = asked_cells(reach, index, blocks)
    held = held_cells(index, asked)
    asked = asked.join(queries.select("place", F.col("vec_id").alias("query_id"), "v", "bound"), "place")
    cell = ["pivot", "ring", "part", "block"]

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(vectors) or not len(queries):
            return empty
        vectors = vectors.sort_values("dist", ignore_index=True)
        x, dist, ids = _matrix(vectors["v"], space.dims), vectors["dist"].to_numpy(), vectors["vec_id"].to_numpy()
        q, pivot = _matrix(queries["v"], space.dims), int(vectors["pivot"].iat[0])
        lifted = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        centre = space.to_pivots(lifted)[:, pivot]
        radius = np.sqrt(queries["bound"].to_numpy()) * (1 + SLACK)
        room = SLACK * (1 + centre)
        first = np.searchsorted(dist, centre - radius - room, "left")
        last = np.searchsorted(dist, centre + radius + room, "right")
        asks, place = queries["query_id"].to_numpy(), np.arange(len(x))[:, None]
        found = []
        for at in range(0, len(q), CHUNK):
            part = at + np.flatnonzero(last[at : at + CHUNK] > first[at : at + CHUNK])
            if not len(part):
                continue
            lo, hi = first[part].min(), last[part].max()
            # No product exceeds the largest squared norm; below 2^53 doubles hold products and sums exactly.
            kind = np.float64 if space.norm2 < 2**52 else np.int64
            exact = x[lo:hi].astype(kind) @ q[part].astype(kind).T
            out = (place[lo:hi] < first[part]) | (place[lo:hi] >= last[part]) | (ids[lo:hi, None] == asks[part])
            row, col = _best(exact, out, ids[lo:hi], k)
            found.append(pd.DataFrame({"query_id": asks[part[col]], "vec_id": ids[lo:hi][row], "score": exact[row, col].astype(np.int64)}))
        return pd.concat(found, ignore_index=True) if found else empty

    grouped = held.select("vec_id", "v", "dist", *cell).groupBy(*cell).cogroup(asked.select("query_id", "v", "bound", *cell).groupBy(*cell))
    return grouped.applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``is_query`` takes, its k best other rows by inner product."""
    rows = cut_lineage(quantised(vectors))
    space = build_space(rows)
    if space is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    padded = rows.select("vec_id", _packed(F.col("v"), space.dims).alias("v"))
    index = cut_lineage(_index(padded, space))
    asked = padded.filter(is_query)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    ids, sample = _sample(padded, PROBE, 2, space.dims)
    probed = _probe(asked, space, ids, sample, k).withColumn("place", F.monotonically_increasing_id())
    queries = cut_lineage(probed).withColumn("old", F.lit(0.0))

    near = cut_lineage(_ranked(_expand(queries, _reach(queries, space, 1 / 3, 0.0), index, space, k, blocks), k))
    full = near.filter(F.col("rank") == k).select(F.col("query_id").alias("__q"), F.col("score").alias("__s"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    better = F.when(F.col("__s").isNotNull(), F.greatest(square + space.norm2 - 2.0 * F.col("__s"), F.lit(0.0)))
    tight = queries.join(full, F.col("vec_id") == F.col("__q"), "left")
    tight = tight.select("place", "vec_id", "v", F.least("bound", F.coalesce(better, F.col("bound"))).alias("bound"), F.col("bound").alias("old"))
    tight = cut_lineage(tight)
    far = _expand(tight, _reach(tight, space, 1.0, 1 / 3), index, space, k, blocks)
    both = near.select("query_id", "vec_id", "score").unionByName(far)
    return _ranked(both, k).select("query_id", "rank", "vec_id", "score")
