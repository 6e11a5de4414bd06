"""Operator 13: approximate nearest neighbours by cosine through robust-pruned directed graphs, one per shard.

Index: equal vectors form a class, whose smallest ``k + 1`` ids are all that any result can need; every class is indexed. Classes
are dealt by a hash into shards of about ``shard_rows``, and each shard becomes a directed graph of bounded out-degree on unit
vectors. Nodes are inserted in growing batches: a greedy beam search from the entry proposes neighbours, and relaxed distance
pruning walks them outwards, dropping a candidate that is ``alpha`` times nearer to a kept neighbour than to the node, so that
kept edges are diverse. Edges are made both ways and pruned again where a node has too many. Further ``sweeps`` insert every
node once more, with the whole graph to search.

Search: every distinct query vector searches each shard by a beam of ``search_beam`` (batches of queries advance in lockstep), the
classes found are scored exactly in double precision on the original vectors, and the best of all shards are ranked. Graphs
are written before they are searched, so a lost executor costs one shard's work. Query vectors are dealt in blocks of ``QUERY_ROWS``, so
no task holds more than a block and a shard. Work grows with queries times shards.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, neither do rows with a null id;
shorter vectors count as padded by zeros, -0.0 as 0.0; repeated rows of one id and vector count once; of several vectors of one
id the best pair counts; a query never meets its own id; ties go to the smaller id; fewer candidates give fewer
rows. Components are scaled by a power of two first, so that squares neither overflow nor vanish; that changes no cosine.

Classes are told apart by 128 bits of hash. Recall is measured against brute force in the tests (5 of 5 nearest).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage, small_side


@dataclass(frozen=True)
class GraphParams:
    degree: int = 32
    build_beam: int = 64
    search_beam: int = 128
    alpha: float = 1.2
    shard_rows: int = 8192
    sweeps: int = 1


QUERY_ROWS = 16_384
BATCH = 1024  # nodes or queries that advance together
WIDTH = 4  # nodes expanded per query and round
BATCH_FLOATS = 16_000_000  # bound on gathered components
HOT_ROWS = 10_000  # queries of one vector per salt
PARTS = 64  # parts of a class whose smallest ids are found apart


# --- one shard -------------------------------------------------------------------------------------------------------


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by a power of two, so that the largest component lies between a half and one."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of corresponding rows, in double precision."""
    x, y = scaled(x), scaled(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


class Graph:
    """Out-edges of unit vectors, -1 where a node has fewer than ``degree``."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entry: int) -> None:
        self.x, self.edges, self.entry = x, edges, entry

    def _batch(self, width: int) -> int:
        return max(16, min(BATCH, BATCH_FLOATS // max(1, width * self.x.shape[1])))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search in lockstep: the nearest nodes found and their squared distances, nearest first."""
        step = self._batch(WIDTH * self.edges.shape[1])
        found = [self._search(queries[i : i + step], beam) for i in range(0, len(queries), step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        count, nodes = len(queries), len(self.x)
        ids = np.full((count, beam), -1, np.int64)
        dist = np.full((count, beam), np.inf, np.float32)
        done = np.ones((count, beam), bool)  # expanded, or no node
        ids[:, 0] = self.entry
        dist[:, 0] = 2 - 2 * queries @ self.x[self.entry]
        done[:, 0] = False
        seen = np.zeros(count * nodes, np.int32)
        seen[np.arange(count) * nodes + self.entry] = 1
        while True:
            open_ = ~done
            row, slot = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= WIDTH))
            if not len(row):
                return ids, dist
            done[row, slot] = True
            near = self.edges[ids[row, slot]].ravel()
            row = np.repeat(row, self.edges.shape[1])
            keep = near >= 0
            near, row = near[keep], row[keep]
            key = row * nodes + near
            keep = seen[key] == 0
            near, row, key = near[keep], row[keep], key[keep]
            stamp = np.arange(1, len(key) + 1, dtype=np.int32)
            seen[key] = stamp
            keep = seen[key] == stamp  # one of several ways to the same node
            near, row = near[keep], row[keep]
            if not len(row):
                continue
            far = 2 - 2 * np.einsum("ij,ij->i", self.x[near], queries[row])
            keep = far < dist[row, -1]
            near, row, far = near[keep], row[keep], far[keep]
            if not len(row):
                continue
            sizes = np.bincount(row, minlength=count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            new_ids = np.full((count, sizes.max()), -1, np.int64)
            new_dist = np.full(new_ids.shape, np.inf, np.float32)
            new_ids[row, place], new_dist[row, place] = near, far
            ids, dist = np.hstack([ids, new_ids]), np.hstack([dist, new_dist])
            done = np.hstack([done, new_ids < 0])
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(a, order, axis=1) for a in (ids, dist, done))

    def prune(self, ids: np.ndarray, dist: np.ndarray, alpha: float) -> np.ndarray:
        """Relaxed distance pruning of candidates (rows, nearest first, -1 for none) to diverse edges."""
        step = self._batch(ids.shape[1])
        return np.concatenate([self._prune(ids[i : i + step], dist[i : i + step], alpha) for i in range(0, len(ids), step)])

    def _prune(self, ids: np.ndarray, dist: np.ndarray, alpha: float) -> np.ndarray:
        rows, degree = np.arange(len(ids)), self.edges.shape[1]
        out = np.full((len(ids), degree), -1, np.int32)
        x, alive = self.x[ids], ids >= 0
        for r in range(degree):
            pick = alive.argmax(axis=1)
            has = alive[rows, pick]
            if not has.any():
                break
            out[:, r] = np.where(has, ids[rows, pick], -1)
            between = 2 - 2 * np.matmul(x, x[rows, pick][:, :, None])[:, :, 0]
            alive &= alpha * alpha * between > dist
            alive[rows, pick] = False
        return out

    def link(self, nodes: np.ndarray, edges: np.ndarray, alpha: float) -> None:
        """Sets the nodes' out-edges and adds the reverse ones, pruning where there are too many."""
        degree = edges.shape[1]
        self.edges[nodes] = edges
        target, source = edges.ravel(), np.repeat(nodes, degree)
        target, source = target[edges.ravel() >= 0].astype(np.int64), source[edges.ravel() >= 0]
        known = (self.edges[target] == source[:, None]).any(axis=1)
        target, source = target[~known], source[~known]
        if not len(target):
            return
        far = 2 - 2 * np.einsum("ij,ij->i", self.x[target], self.x[source])
        order = np.lexsort((source, far, target))
        target, source, far = target[order], source[order], far[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        near = place < degree  # of many new in-edges the nearest are considered
        target, source, far, place = target[near], source[near], far[near], place[near]
        hubs, row = np.unique(target, return_inverse=True)
        ids = np.full((len(hubs), 2 * degree), -1, np.int64)
        ids[:, :degree] = self.edges[hubs]
        ids[row, degree + place] = source
        dist = np.where(ids >= 0, 2 - 2 * np.matmul(self.x[ids], self.x[hubs][:, :, None])[:, :, 0], np.inf)
        by = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, by, axis=1), np.take_along_axis(dist, by, axis=1)
        full = (ids >= 0).sum(axis=1) > degree
        self.edges[hubs[~full]] = ids[~full, :degree]
        if full.any():
            self.edges[hubs[full]] = self.prune(ids[full], dist[full], alpha)


def build(x: np.ndarray, params: GraphParams) -> Graph:
    """The graph of a shard's unit vectors."""
    n, degree = len(x), params.degree
    centre = x.mean(axis=0)
    entry = int(np.argmax(x @ centre)) if n else 0
    graph = Graph(x, np.full((n, degree), -1, np.int32), entry)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]]) if n else order
    for sweep in range(params.sweeps):
        at = 1 if sweep == 0 else 0
        while at < n:
            nodes = order[at : at + (min(BATCH, at) if sweep == 0 else BATCH)]
            at += len(nodes)
            ids, dist = graph.search(x[nodes], params.build_beam)
            held = graph.edges[nodes].astype(np.int64)
            ids = np.hstack([np.where(ids == nodes[:, None], -1, ids), np.where((held[:, :, None] == ids[:, None, :]).any(axis=2), -1, held)])
            apart = 2 - 2 * np.matmul(x[held], x[nodes][:, :, None])[:, :, 0]
            dist = np.where(ids >= 0, np.hstack([dist, apart]), np.inf)
            by = np.argsort(dist, axis=1, kind="stable")
            ids, dist = np.take_along_axis(ids, by, axis=1), np.take_along_axis(dist, by, axis=1)
            graph.link(nodes, graph.prune(ids, dist, params.alpha), params.alpha)
    return graph


# --- on Spark --------------------------------------------------------------------------------------------------------

CLASS = ["__hi", "__lo"]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` and the class of the vector, of the rows that take part; trailing zeros do not tell vectors apart."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine & F.exists(v, lambda x: x != 0))
    # Trailing zeros go, -0.0 becomes 0.0.
    whole = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    last = F.array_max(F.transform(v, lambda x, i: F.when(x != 0, i + 1)))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.slice(whole, 1, last).alias("v"))
    return rows.select("vec_id", "v", F.xxhash64("v").alias("__hi"), F.xxhash64(F.lit(13), "v").alias("__lo"))


def _smallest(ids: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k smallest ids of every group; map-side cut first, so that a hot group sends k rows a task."""
    order = Window.partitionBy(*group).orderBy("vec_id")
    return ids.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``__hi, __lo, v, ids`` of every distinct vector, with its k smallest ids."""
    ids = rows.select(*CLASS, "vec_id").distinct().withColumn("__part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)))
    few = _smallest(_smallest(ids, [*CLASS, "__part"], k), CLASS, k)
    members = few.groupBy(*CLASS).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return rows.groupBy(*CLASS).agg(F.first("v").alias("v")).join(members, CLASS)


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def build_index(held: DataFrame, dims: int, params: GraphParams) -> tuple[DataFrame, int]:
    """``shard, node, entry, v, ids, edges``, written; and the number of shards."""
    shards = max(1, -(-held.count() // params.shard_rows))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(CLASS, ignore_index=True)
        graph = build(unit(_matrix(part["v"], dims)), params)
        out = part[["shard", "v", "ids"]].copy()
        out["node"], out["entry"], out["edges"] = np.arange(len(part), dtype=np.int32), np.int32(graph.entry), list(graph.edges)
        return out[["shard", "node", "entry", "v", "ids", "edges"]]

    dealt = held.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), *CLASS), F.lit(shards)).cast("int"))
    schema = "shard int, node int, entry int, v array<double>, ids array<bigint>, edges array<int>"
    return cut_lineage(dealt.groupBy("shard").applyInPandas(run, schema)), shards


def search_shard(part: pd.DataFrame, queries: np.ndarray, k: int, params: GraphParams) -> pd.DataFrame:
    """``query`` (row), ``vec_id``, ``score``: the k best ids found for each query in one shard, all ids apart."""
    part = part.sort_values("node", ignore_index=True)
    own = _matrix(part["v"], queries.shape[1])
    graph = Graph(unit(own), np.array(part["edges"].tolist(), np.int32).reshape(len(part), -1), int(part["entry"].iat[0]))
    ids, _ = graph.search(unit(queries), min(params.search_beam, max(k, len(part))))
    row, slot = np.nonzero(ids >= 0)
    node = ids[row, slot]
    score = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        some = slice(at, at + (1 << 16))
        score[some] = cosines(queries[row[some]], own[node[some]])
    sizes = np.array([len(x) for x in part["ids"]])
    members = np.concatenate(part["ids"].to_numpy())
    first = np.cumsum(sizes) - sizes
    # Only classes that reach the k-th best class can hold one of the k best ids.
    order = np.lexsort((-score, row))
    place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    kth = np.full(len(queries), -np.inf)
    kth[row[order][place == k - 1]] = score[order][place == k - 1]
    keep = score >= kth[row]
    row, node, score = row[keep], node[keep], score[keep]
    times = sizes[node]
    at = np.repeat(first[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    found = pd.DataFrame({"query": np.repeat(row, times), "vec_id": members[at], "score": np.repeat(score, times)})
    found = found.sort_values(["query", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query", "vec_id"])
    return found.groupby("query").head(k)


def _search(index: DataFrame, shards: int, queries: DataFrame, dims: int, k: int, params: GraphParams) -> DataFrame:
    """``__hi, __lo, vec_id, score``: the k best ids that any shard found for each distinct query vector."""
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(3), *CLASS), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(wanted):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in (*CLASS, "vec_id", "score")})
        found = search_shard(part, _matrix(wanted["v"], dims), k, params)
        names = wanted[CLASS].iloc[found["query"]].reset_index(drop=True)
        return pd.concat([names, found[["vec_id", "score"]].reset_index(drop=True)], axis=1)

    met = held.groupBy("shard", "block").cogroup(asked.select("shard", "block", *CLASS, "v").groupBy("shard", "block"))
    found = met.applyInPandas(run, "__hi bigint, __lo bigint, vec_id bigint, score double")
    best = found.groupBy(*CLASS, "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*CLASS).orderBy(F.desc("score"), "vec_id")
    return best.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, params: GraphParams = GraphParams()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``is_query`` (on ``vec_id``) takes, the k nearest rows found."""
    rows = usable(vectors)
    held = cut_lineage(classes(rows, k + 1))
    dims = held.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index, shards = build_index(held, dims, params)
    asking = cut_lineage(rows.filter(is_query).select(*CLASS, "vec_id").distinct())
    sizes = asking.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("__n"))
    wanted = held.select(*CLASS, "v").join(sizes, CLASS)
    wanted = cut_lineage(wanted.select(*CLASS, "v", F.ceil(F.col("__n") / HOT_ROWS).cast("int").alias("salts")))
    # One more than k: a query's own id is among them at most once.
    found = _search(index, shards, wanted.select(*CLASS, "v"), dims, k + 1, params)
    salts = wanted.select(*CLASS, "salts")
    spread = cut_lineage(found.join(salts, CLASS)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    salted = asking.withColumnRenamed("vec_id", "query_id").join(small_side(salts), CLASS)
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int"))
    pairs = salted.join(spread, [*CLASS, "salt"]).filter("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
