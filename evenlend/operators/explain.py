"""Additive feature attributions of boosted trees (path-dependent), computed for whole batches from flat node arrays.

All rows of a batch walk a tree level by level; each node keeps, as bits, which edges of its path a row satisfies. What a leaf
contributes to a feature is the Shapley value of a product game over the path's distinct features: each factor is 1 or 0 for a
row that satisfies the feature's splits or not, and the share of training weight that does where the feature is unknown.

Shapley weights are integrals of ``t^s (1-t)^(m-1-s)``, so the sum over all subsets is the integral of a product of
``t * known + (1-t) * unknown`` over the other features. It is a polynomial of degree below the path's length, which a few
Gauss-Legendre points integrate exactly. It depends on the row only through the bits, so it is tabled per tree and bit
pattern, and a batch looks all leaves up at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .trees import BoostModel, Trees

TABLE_DEPTH = 8  # deeper trees table only the patterns that a batch shows
CELLS = 4_000_000  # looked up at a time


@dataclass(frozen=True)
class Paths:
    """One tree's nodes by level, and the paths to its leaves."""

    levels: list[tuple[np.ndarray, ...]]  # inner nodes of a level: places in the trees, own places, those of the children
    size: int
    leaves: np.ndarray
    value: np.ndarray  # of the leaves
    slot: np.ndarray  # leaves x depth: which distinct feature of its path an edge belongs to, -1 beyond the leaf
    feature: np.ndarray  # leaves x slots, -1 where a path has fewer distinct features
    share: np.ndarray  # leaves x slots: training weight that passes the feature's splits

    @classmethod
    def of(cls, trees: Trees, root: int) -> Paths:
        levels, here, paths = [], [int(root)], {int(root): []}
        places = {int(root): 0}
        while here:
            inner = [n for n in here if trees.feature[n] >= 0]
            here = []
            for n in inner:
                for child in (int(trees.left[n]), int(trees.right[n])):
                    places[child] = len(places)
                    ratio = trees.cover[child] / trees.cover[n]
                    paths[child] = [*paths[n], (int(trees.feature[n]), ratio)]
                    here.append(child)
            if inner:
                own, left, right = ([places[int(n)] for n in side] for side in (inner, trees.left[inner], trees.right[inner]))
                levels.append(tuple(np.array(x) for x in (inner, own, left, right)))
        leaves = [n for n in places if trees.feature[n] < 0]
        named = [list(dict.fromkeys(f for f, _ in paths[n])) for n in leaves]
        depth, slots = max(1, len(levels)), max([1, *map(len, named)])
        slot = np.full((len(leaves), depth), -1)
        feature = np.full((len(leaves), slots), -1)
        share = np.ones((len(leaves), slots))
        for i, (n, names) in enumerate(zip(leaves, named)):
            feature[i, : len(names)] = names
            for d, (f, ratio) in enumerate(paths[n]):
                slot[i, d] = names.index(f)
                share[i, slot[i, d]] *= ratio
        return cls(levels, len(places), np.array([places[n] for n in leaves]), trees.value[leaves], slot, feature, share)

    def codes(self, trees: Trees, x: np.ndarray) -> np.ndarray:
        """Rows x leaves: bit d says that the row leaves the path's d-th node as the path does."""
        code = np.zeros((len(x), self.size), np.int64)
        for d, (nodes, own, left, right) in enumerate(self.levels):
            goes = trees.goes_left(x, np.broadcast_to(nodes, (len(x), len(nodes)))).astype(np.int64)
            code[:, left], code[:, right] = code[:, own] | (goes << d), code[:, own] | ((1 - goes) << d)
        return code[:, self.leaves]

    def known(self, patterns: np.ndarray) -> np.ndarray:
        """Patterns x leaves x slots: whether the path's splits on a feature are all satisfied."""
        out = np.ones((len(patterns), *self.feature.shape), bool)
        for d in range(self.slot.shape[1]):
            has = np.flatnonzero(self.slot[:, d] >= 0)
            out[:, has, self.slot[has, d]] &= ((patterns >> d) & 1 == 1)[:, None]
        return out

    def _factors(self, patterns: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gap of each factor, the factors at the integration points, their product and the points' weights."""
        known = self.known(patterns).astype(float)
        points, weights = np.polynomial.legendre.leggauss(max(1, -(-(known.shape[2] - skip + 1) // 2)))
        t = ((points + 1) / 2)[:, None, None, None]
        each = t * known + (1 - t) * self.share
        return known - self.share, each, each.prod(axis=3), weights / 2

    def values(self, patterns: np.ndarray) -> np.ndarray:
        """Contributions, patterns x leaves x slots."""
        gap, each, whole, weights = self._factors(patterns, 1)
        return self.value[:, None] * gap * np.einsum("q,qpls->pls", weights, whole[..., None] / each)

    def pairs(self, patterns: np.ndarray) -> np.ndarray:
        """Contributions of pairs of slots (upper triangle), patterns x leaves x pairs; half of what the pair adds together."""
        gap, each, whole, weights = self._factors(patterns, 2)
        i, j = np.triu_indices(gap.shape[2], 1)
        rest = np.einsum("q,qplk->plk", weights / 2, whole[..., None] / (each[..., i] * each[..., j]))
        return self.value[:, None] * gap[..., i] * gap[..., j] * rest


class Explainer:
    """Contributions of a model's trees for batches of rows."""

    def __init__(self, trees: Trees, width: int) -> None:
        self.trees, self.width = trees, width
        self.paths = [Paths.of(trees, r) for r in trees.roots]

    @property
    def base(self) -> float:
        return float(sum((p.value * p.share.prod(axis=1)).sum() for p in self.paths))

    def _add(self, out: np.ndarray, x: np.ndarray, path: Paths, table, place: np.ndarray) -> None:
        """Adds to ``out`` (rows x places) what all leaves of a tree contribute; ``place`` is -1 for padding."""
        leaf, slot = np.nonzero(place >= 0)
        if not len(leaf):
            return
        by = np.argsort(place[leaf, slot], kind="stable")
        leaf, slot = leaf[by], slot[by]
        where, starts = np.unique(place[leaf, slot], return_index=True)
        step = max(1, CELLS // len(leaf))
        full = np.arange(1 << path.slot.shape[1]) if path.slot.shape[1] <= TABLE_DEPTH else None
        cells = None if full is None else table(full)[:, leaf, slot]
        for at in range(0, len(x), step):
            codes = path.codes(self.trees, x[at : at + step])
            if full is None:
                patterns, codes = np.unique(codes, return_inverse=True)
                cells = table(patterns)[:, leaf, slot]
                codes = codes.reshape(-1, len(path.leaves))
            found = cells.ravel()[codes[:, leaf] * len(leaf) + np.arange(len(leaf))]
            out[at : at + step, where] += np.add.reduceat(found, starts, axis=1)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Rows x features."""
        phi = np.zeros((len(x), self.width))
        for path in self.paths:
            self._add(phi, x, path, path.values, path.feature)
        return phi

    def pairs(self, x: np.ndarray) -> np.ndarray:
        """Rows x pairs of features, upper triangle with the diagonal: a feature's own effect is what pairs leave of it."""
        p = self.width
        one, two = np.triu_indices(p)
        place = np.full((p, p), -1)
        place[one, two] = np.arange(len(one))
        out = np.zeros((len(x), len(one)))
        for path in self.paths:
            i, j = np.triu_indices(path.feature.shape[1], 1)
            a, b = path.feature[:, i], path.feature[:, j]
            both = np.where((a >= 0) & (b >= 0), place[np.minimum(a, b), np.maximum(a, b)], -1)
            self._add(out, x, path, path.pairs, both)
        own = self.values(x)
        mixed = one != two
        for ends in (one, two):
            np.subtract.at(own.T, ends[mixed], out[:, mixed].T)
        out[:, place[np.arange(p), np.arange(p)]] = own
        return out


def _inputs(model: BoostModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    carried = [F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)]
    return df.select(*carried, *[F.col(f"`{c}`").cast("double").alias(f"__x_{i}") for i, c in enumerate(model.features)])


def _matrix(batch: pd.DataFrame, width: int) -> np.ndarray:
    return batch[[f"__x_{i}" for i in range(width)]].to_numpy(dtype=float)


def shap_values(model: BoostModel, df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """``key, <keep>, base, shap_<feature>...``: contributions to the margin; base plus their sum is the margin."""
    features, carried = model.features, [key, *keep]
    rows = _inputs(model, df, carried)
    shared = df.sparkSession.sparkContext.broadcast(Explainer(model.trees(), len(features)))
    schema = T.StructType(
        [T.StructField(c, rows.schema[f"__keep_{i}"].dataType) for i, c in enumerate(carried)]
        + [T.StructField("base", T.DoubleType())]
        + [T.StructField(f"shap_{c}", T.DoubleType()) for c in features]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        explainer = shared.value
        base = explainer.base
        for batch in batches:
            phi = explainer.values(_matrix(batch, len(features)))
            out = {c: batch[f"__keep_{i}"] for i, c in enumerate(carried)}
            out["base"] = np.full(len(batch), base)
            out.update({f"shap_{c}": phi[:, j] for j, c in enumerate(features)})
            yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def shap_columns(shap: DataFrame) -> list[str]:
    return [c for c in shap.columns if c.startswith("shap_")]


def shap_long(shap: DataFrame, key: str) -> DataFrame:
    """``key, feature, value, phi``, one row per applicant and feature; the value is there if its column was carried along."""
    cells = [
        F.struct(
            F.lit(c[5:]).alias("feature"),
            (F.col(f"`{c[5:]}`").cast("double") if c[5:] in shap.columns else F.lit(None).cast("double")).alias("value"),
            F.col(f"`{c}`").alias("phi"),
        )
        for c in shap_columns(shap)
    ]
    return shap.select(key, F.inline(F.array(*cells)))


def _per_feature(row: DataFrame, names: Sequence[str], fields: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    cells = [
        F.struct(F.lit(c[5:]).alias("feature"), *[F.col(f"{f}{i}").alias(f) for f in fields])
        for i, c in enumerate(names)
    ]
    return row.select(*groups, F.inline(F.array(*cells)))


def mean_abs_shap(shap: DataFrame) -> DataFrame:
    """``feature, mean_abs``, largest first; aggregated in the wide form, so rows are never multiplied."""
    names = shap_columns(shap)
    row = shap.agg(*[F.avg(F.abs(F.col(f"`{c}`"))).alias(f"mean_abs{i}") for i, c in enumerate(names)])
    return _per_feature(row, names, ["mean_abs"]).orderBy(F.col("mean_abs").desc(), "feature")


def shap_by_group(shap: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``groups, feature, mean_phi, mean_abs`` of a table whose group columns were carried along."""
    names = shap_columns(shap)
    stats = [
        e
        for i, c in enumerate(names)
        for e in (F.avg(F.col(f"`{c}`")).alias(f"mean_phi{i}"), F.avg(F.abs(F.col(f"`{c}`"))).alias(f"mean_abs{i}"))
    ]
    return _per_feature(shap.groupBy(*groups).agg(*stats), names, ["mean_phi", "mean_abs"], groups)


def attach_groups(shap: DataFrame, df: DataFrame, key: str, groups: Sequence[str]) -> DataFrame:
    """Group and label columns joined to a saved attribution table by key."""
    return shap.join(df.select(key, *groups), key)


def shap_pairs(model: BoostModel, df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """``key, <keep>, phi``: the values of all pairs of features (upper triangle, row by row) as one array, so rows are not multiplied."""
    features, carried = model.features, [key, *keep]
    rows = _inputs(model, df, carried)
    shared = df.sparkSession.sparkContext.broadcast(Explainer(model.trees(), len(features)))
    schema = T.StructType([T.StructField(c, rows.schema[f"__keep_{i}"].dataType) for i, c in enumerate(carried)] + [T.StructField("phi", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explainer = shared.value
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[len(carried) :]])
            found = explainer.pairs(x)
            places = pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32())
            phi = pa.ListArray.from_arrays(places, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], phi], [*carried, "phi"])

    return rows.mapInArrow(run, schema)


def shap_interactions(model: BoostModel, df: DataFrame, key: str) -> DataFrame:
    """``key, feature_1, feature_2, phi`` for every pair once, features in the model's order.

    A mixed pair's value counts for each of its two features: per row the own effects and twice the mixed values add up to
    margin minus base.
    """
    features = model.features
    one, two = np.triu_indices(len(features))
    names = [F.array(*[F.lit(features[i]) for i in side]) for side in (one, two)]
    return shap_pairs(model, df, key).select(key, F.posexplode("phi").alias("cell", "phi")).select(
        key, F.get(names[0], F.col("cell")).alias("feature_1"), F.get(names[1], F.col("cell")).alias("feature_2"), "phi"
    )


def pairs_total(features: Sequence[str]) -> Column:
    """What the pairs ``phi`` of a row add up to; a mixed pair counts for both of its features."""
    one, two = np.triu_indices(len(features))
    times = F.array(*[F.lit(1.0 if i == j else 2.0) for i, j in zip(one, two)])
    return F.aggregate(F.zip_with("phi", times, lambda v, n: v * n), F.lit(0.0), lambda total, v: total + v)


def mean_abs_interactions(model: BoostModel, df: DataFrame) -> DataFrame:
    """``feature_1, feature_2, mean_abs`` of every pair once: tasks send one row of partial sums per pair, not one per applicant."""
    features = model.features
    rows = _inputs(model, df, [])
    shared = df.sparkSession.sparkContext.broadcast(Explainer(model.trees(), len(features)))
    one, two = np.triu_indices(len(features))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(one)), 0
        for batch in batches:
            x = _matrix(batch, len(features))
            total += np.abs(shared.value.pairs(x)).sum(axis=0)
            n += len(x)
        yield pd.DataFrame({"feature_1": np.array(features, object)[one], "feature_2": np.array(features, object)[two], "total": total, "n": n})

    parts = rows.mapInPandas(run, "feature_1 string, feature_2 string, total double, n bigint")
    return parts.groupBy("feature_1", "feature_2").agg((F.sum("total") / F.sum("n")).alias("mean_abs"))
