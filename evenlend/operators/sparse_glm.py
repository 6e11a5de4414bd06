"""Logit fits from sparse rows: wide factors, and many models in one pass over the data.

A row is one (column, value) pair per formula term, however many levels a factor has. One pass adds up the score and the normal
equations of all models that have not converged yet, so the number of jobs grows with iterations, not with models. Sums arrive as
(row, column) cells that occur; no row is ever a dense vector.

Designs of a single factor, or of factors with at most ``PATTERNS`` combinations of levels, are counted first: equal rows are one row with
a weight, and the passes of a fit, and its scores, read these counts only.

Designs of more than ``DENSE`` columns are solved by blocks. The levels of the widest factor never occur together, so their block of the
normal equations is diagonal and is eliminated; what is left has the size of the other columns. There the widest factor
counts as the first term when redundant columns are looked for.

The only factor of a design may have a table of levels (``LongLevels``). Then every level's log odds depend on its rows and positives
alone; passes read how often each such pair occurs, and the estimates stay a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .designs import ALIAS_TOLERANCE, INTERCEPT, Design, LogitModel, LongNames, LongTerms

DENSE = 1024
CHUNK_ROWS = 2048
PATTERNS = 1 << 20
FEW_PAIRS = 1 << 16  # different numbers of rows and positives that the driver holds
LEAST_STEP = 1e-14  # squared, in units of a column's information


@dataclass(frozen=True)
class Term:
    """Where a block of columns starts, how many there are, and the singles it is made of."""

    start: int
    size: int
    parts: tuple[int, ...]


class Encoder:
    """Rows of a design as one column number and value per term; column 0 is the intercept."""

    def __init__(self, design: Design, inputs: Mapping[str, int], means: Mapping[str, float] | None = None) -> None:
        self.levels = [tuple(design.levels[f]) if f in design.levels else None for f in design.features]
        self.inputs = [inputs[f] for f in design.features]
        self.means = [0.0 if f in design.levels or not means else means[f] for f in design.features]
        sizes = [1 if found is None else max(0, len(found) - 1) for found in self.levels]
        place = {f: i for i, f in enumerate(design.features)}
        self.terms, at = [], 1
        for parts in [(i,) for i in range(len(sizes))] + [(place[a], place[b]) for a, b in design.interactions]:
            size = math.prod(sizes[i] for i in parts)
            self.terms.append(Term(at, size, parts))
            at += size
        self.width = at

    def encode(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column numbers and values (rows x terms, the intercept first), and which rows are complete."""
        rows = len(batch)
        complete = np.ones(rows, bool)
        own, raw = [], []
        for levels, place in zip(self.levels, self.inputs):
            column = batch.column(place)
            if levels is None:
                x = column.to_numpy(zero_copy_only=False).astype(float)
                complete &= ~np.isnan(x)
                own.append(np.zeros(rows, np.int64))
                raw.append(x)
            else:
                code = pc.fill_null(pc.index_in(column, value_set=pa.array(levels, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                complete &= code >= 0
                own.append(np.maximum(code - 1, 0))
                raw.append((code > 0).astype(float))
        index, value = [np.zeros(rows, np.int64)], [np.ones(rows)]
        for term in self.terms:
            if not term.size:
                continue
            if len(term.parts) == 1:
                (i,) = term.parts
                index.append(term.start + own[i])
                value.append(raw[i] - self.means[i])
            else:
                i, j = term.parts
                inner = 1 if self.levels[j] is None else len(self.levels[j]) - 1
                index.append(term.start + own[i] * inner + own[j])
                value.append(raw[i] * raw[j])
        return np.stack(index, axis=1)[complete], np.stack(value, axis=1)[complete], complete

    def widest(self, design: Design) -> range:
        """Columns of the widest factor."""
        factors = [t for t, found in zip(self.terms, self.levels) if found is not None]
        best = max(factors, key=lambda t: t.size, default=Term(1, 0, ()))
        return range(best.start, best.start + best.size)


class Cells:
    """Sums per (column, column), those that occur."""

    def __init__(self, width: int) -> None:
        self.width, self.dense = width, np.zeros((width, width)) if width <= DENSE else None
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0)

    def add(self, index: np.ndarray, value: np.ndarray, weight: np.ndarray) -> None:
        if self.dense is not None:
            x = np.zeros((len(index), self.width))
            np.add.at(x, (np.arange(len(index))[:, None], index), value)
            self.dense += x.T @ (x * weight[:, None])
            return
        a, b = np.triu_indices(index.shape[1])
        low, high = np.minimum(index[:, a], index[:, b]), np.maximum(index[:, a], index[:, b])
        cells = value[:, a] * value[:, b] * weight[:, None]
        found = cells != 0
        keys = np.concatenate([self.keys, (low * self.width + high)[found]])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.sums = np.bincount(place, np.concatenate([self.sums, cells[found]]), len(self.keys))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.dense is not None:
            i, j = np.triu_indices(self.width)
            found = self.dense[i, j] != 0
            return i[found], j[found], self.dense[i, j][found]
        return self.keys // self.width, self.keys % self.width, self.sums


def _predict(beta: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (beta[index] * value).sum(axis=1)


def countable(design: Design) -> bool:
    """Whether equal rows of the design are combined before it is fitted."""
    factors = all(f in design.levels for f in design.features)
    return factors and (len(design.features) == 1 or math.prod(len(design.levels[f]) for f in design.features) <= PATTERNS)


def _label(name: str) -> Column:
    return F.col(f"`{name}`").cast("double").alias("y")


def pattern_counts(df: DataFrame, label: str, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """``model, key, y, n``: how often each combination of the values of a model's features (as text) occurs with each label."""
    if not keys:
        return df.sparkSession.createDataFrame([], "model string, key array<string>, y double, n bigint")
    cells = [F.struct(F.lit(n).alias("model"), F.array(*[F.col(f"`{f}`").cast("string") for f in own]).alias("key")) for n, own in keys.items()]
    rows = df.select(_label(label), F.inline(F.array(*cells)))
    return cut_lineage(rows.groupBy("model", "key", "y").agg(F.count(F.lit(1)).alias("n")))


def countable_keys(designs: Mapping[str, Design]) -> dict[str, tuple[str, ...]]:
    return {n: d.features for n, d in designs.items() if countable(d)}


def _keyed(design: Design) -> dict[str, int]:
    """Places of the features in a key."""
    return {f: i for i, f in enumerate(design.features)}


def _by_model(batch: pa.RecordBatch, widths: Mapping[str, int]) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Counted rows of each model: its features as columns, the labels and the counts."""
    for name in pc.unique(batch.column(0)).to_pylist():
        if name not in widths:
            continue
        own, width = batch.filter(pc.equal(batch.column(0), name)), widths[name]
        flat = pc.list_flatten(own.column(1))
        parts = [flat.take(pa.array(np.arange(i, len(flat), width))) for i in range(width)]
        yield name, pa.RecordBatch.from_arrays(parts, [f"f{i}" for i in range(width)]), own.column(2).to_numpy(), own.column(3).to_numpy()


@dataclass(frozen=True)
class Sources:
    """Rows for the models that need them, ``pattern_counts`` for the numbers in ``grouped``; names of all models."""

    rows: DataFrame
    counted: DataFrame | None
    names: tuple[str, ...]
    grouped: frozenset[int]


def _pass(sources: Sources, models: Mapping[int, tuple[Encoder, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per model: rows, positives and loss; score; cells of the normal equations as (row, column) pairs and sums."""
    few, many = ({m: s for m, s in models.items() if (m in sources.grouped) == wanted} for wanted in (True, False))
    out = _sums(sources.counted, few, sources.names) if few else {}
    return {**out, **_sums(sources.rows, many)} if many else out


def _sums(
    rows: DataFrame, models: Mapping[int, tuple[Encoder, np.ndarray]], names: Sequence[str] | None = None
) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``_pass`` over one kind of rows; with ``names`` of all models those of ``pattern_counts``."""
    numbers = {names[m]: m for m in models} if names else {}
    widths = {n: len(models[m][0].inputs) for n, m in numbers.items()}

    def parts_of(part: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
        if names:
            for name, own, labels, counts in _by_model(part, widths):
                yield numbers[name], own, labels, counts
        else:
            labels = part.column(0).to_numpy()
            for m in models:
                yield m, part, labels, np.ones(len(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {m: (np.zeros(3), np.zeros(e.width), Cells(e.width)) for m, (e, _) in models.items()}
        for batch in batches:
            for at in range(0, len(batch), CHUNK_ROWS):
                for m, part, labels, counts in parts_of(batch.slice(at, CHUNK_ROWS)):
                    encoder, beta = models[m]
                    index, value, complete = encoder.encode(part)
                    y, n = labels[complete], counts[complete]
                    eta = _predict(beta, index, value)
                    p = 1.0 / (1.0 + np.exp(-eta))
                    size, score, cells = totals[m]
                    size += n.sum(), (n * y).sum(), (n * (np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta))) - y * eta)).sum()
                    score += np.bincount(index.ravel(), (value * (n * (y - p))[:, None]).ravel(), encoder.width)
                    cells.add(index, value, n * p * (1.0 - p))
        for m, (size, score, cells) in totals.items():
            i, j, v = cells.rows()
            used = np.flatnonzero(score)
            i = np.concatenate([np.full(3, -2), np.full(len(used), -1), i])
            j = np.concatenate([np.arange(3), used, j])
            columns = [np.full(len(i), m), i, j, np.concatenate([size, score[used], v])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["model", "i", "j", "v"])

    parts = rows.mapInArrow(run, "model bigint, i bigint, j bigint, v double")
    summed = parts.groupBy("model", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for m, (encoder, _) in models.items():
        own = summed[summed["model"] == m]
        kind, j, v = own["i"].to_numpy(), own["j"].to_numpy(), own["v"].to_numpy()
        size, score = np.zeros(3), np.zeros(encoder.width)
        size[j[kind == -2]] = v[kind == -2]
        score[j[kind == -1]] = v[kind == -1]
        cell = kind >= 0
        out[m] = size, score, np.stack([kind[cell], j[cell]], axis=1), v[cell]
    return out


class Normal:
    """Normal equations with the columns ``apart`` (which never occur together) eliminated."""

    def __init__(self, width: int, cells: np.ndarray, sums: np.ndarray, apart: range, used: np.ndarray | None = None) -> None:
        self.apart = np.array(apart, np.int64)
        self.rest = np.setdiff1d(np.arange(width), self.apart)
        place = np.empty(width, np.int64)
        place[self.apart], place[self.rest] = np.arange(len(self.apart)), np.arange(len(self.rest))
        inside = np.zeros(width, bool)
        inside[self.apart] = True
        i, j = cells.T
        self.diagonal = np.zeros(len(self.apart))
        self.border = np.zeros((len(self.apart), len(self.rest)))
        self.core = np.zeros((len(self.rest), len(self.rest)))
        both, none = inside[i] & inside[j], ~inside[i] & ~inside[j]
        self.diagonal[place[i[both]]] = sums[both]
        self.core[place[i[none]], place[j[none]]] = self.core[place[j[none]], place[i[none]]] = sums[none]
        mixed = ~both & ~none
        level, other = np.where(inside[i], i, j)[mixed], np.where(inside[i], j, i)[mixed]
        self.border[place[level], place[other]] = sums[mixed]
        self.used = np.ones(width, bool) if used is None else used
        with np.errstate(divide="ignore", invalid="ignore"):
            self.ratio = np.where(self.diagonal[:, None] > 0, self.border / self.diagonal[:, None], 0.0)
        self.left = self.core - self.border.T @ self.ratio

    def redundant(self) -> np.ndarray:
        """Columns that are combinations of the intercept, the columns apart and earlier ones, by one elimination in that order."""
        out = np.zeros(len(self.used), bool)
        out[self.apart] = self.diagonal <= 0
        mean = self.core[0] / self.core[0, 0]
        spread = np.diag(self.core) - self.core[0] * mean
        spread[0] = self.core[0, 0]
        left = self.left.copy()
        for j, column in enumerate(self.rest):
            if spread[j] <= 0 or left[j, j] < ALIAS_TOLERANCE * spread[j]:
                out[column] = True
                continue
            below = left[j + 1 :, j]
            left[j + 1 :, j + 1 :] -= np.outer(below / left[j, j], below)
        return out

    def _open(self) -> tuple[np.ndarray, np.ndarray]:
        return np.flatnonzero(self.used[self.rest]), np.flatnonzero(self.used[self.apart])

    def step(self, score: np.ndarray) -> np.ndarray:
        """The Newton step; 0 for columns that are left out."""
        rest, apart = self._open()
        out = np.zeros(len(score))
        levels = score[self.apart]
        right = (score[self.rest] - self.ratio.T @ levels)[rest]
        solved = np.zeros(len(self.rest))
        solved[rest] = np.linalg.solve(self.left[np.ix_(rest, rest)], right)
        out[self.rest] = solved
        out[self.apart[apart]] = levels[apart] / self.diagonal[apart] - self.ratio[apart] @ solved
        return out

    def gain(self, step: np.ndarray) -> float:
        """The largest square of a column's step, times the column's information."""
        information = np.zeros(len(step))
        information[self.rest], information[self.apart] = np.diag(self.core), self.diagonal
        return float((step * step * information).max())

    def covariance(self) -> tuple[np.ndarray, np.ndarray]:
        """Variances of all columns (NaN for those left out), and the covariance of the columns not apart."""
        rest, apart = self._open()
        core = np.full((len(self.rest), len(self.rest)), 0.0)
        core[np.ix_(rest, rest)] = np.linalg.inv(self.left[np.ix_(rest, rest)])
        out = np.full(len(self.used), np.nan)
        out[self.rest[rest]] = np.diag(core)[rest]
        out[self.apart[apart]] = 1.0 / self.diagonal[apart] + np.einsum("li,ij,lj->l", self.ratio[apart], core, self.ratio[apart])
        return out, core


def _inputs(df: DataFrame, designs: Sequence[Design]) -> tuple[list[Column], dict[str, int]]:
    """Feature columns in the form that encoders read, and their places after the label."""
    factors = {f: f in d.levels for d in designs for f in d.features}
    columns = [F.col(f"`{f}`").cast("string" if is_factor else "double").alias(f"f{i}") for i, (f, is_factor) in enumerate(factors.items())]
    return columns, {f: i + 1 for i, f in enumerate(factors)}


def fit_many(
    df: DataFrame, designs: Mapping[str, Design], max_iter: int = 50, tol: float = 1e-10, counted: DataFrame | None = None
) -> dict[str, LogitModel]:
    """Maximum-likelihood fits of several designs with the same label, each on its own complete rows.

    Models leave as their deviance settles and each column's own part of it has (a settled sum over many levels says little about one);
    steps that make it worse are halved. Columns that separate the labels have no maximum: their steps do not shrink and end the fit.
    ``counted`` are the ``pattern_counts`` of the rows, if they are there already.
    """
    names = list(designs)
    grouped = {m for m, n in enumerate(names) if countable(designs[n])}
    plain = [designs[n] for m, n in enumerate(names) if m not in grouped]
    columns, places = _inputs(df, plain)
    rows = df.select(_label(designs[names[0]].label), *columns).filter(F.col("y").isNotNull() & ~F.isnan("y")).persist(StorageLevel.MEMORY_AND_DISK)
    if counted is None and grouped:
        counted = pattern_counts(df, designs[names[0]].label, countable_keys(designs))
    counted = None if counted is None else counted.filter(F.col("y").isNotNull() & ~F.isnan("y"))
    try:
        numbers = [c for c, t in rows.dtypes[1:] if t == "double"]
        fine = [F.avg(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))).alias(c) for c in numbers]
        middle = rows.agg(*fine).first().asDict() if fine else {}
        means = {f: middle.get(f"f{i - 1}") or 0.0 for f, i in places.items()}
        states = {}
        for m, name in enumerate(names):
            encoder = Encoder(designs[name], _keyed(designs[name]) if m in grouped else places, means)
            # beta, step from, deviance there, columns used, gain of the step that a settled deviance would take
            states[m] = [encoder, np.zeros(encoder.width), None, math.inf, None, math.inf]
        sources = Sources(rows, counted, tuple(names), frozenset(grouped))
        done: dict[str, LogitModel] = {}
        for turn in range(max_iter + 1):
            found = _pass(sources, {m: (s[0], s[1]) for m, s in states.items()})
            for m, (size, score, cells, sums) in found.items():
                encoder, beta, before, old, used, last = states[m]
                design, deviance = designs[names[m]], 2.0 * float(size[2])
                if not 0 < size[1] < size[0]:
                    done[names[m]] = _one_class(design, int(size[0]))
                    del states[m]
                    continue
                apart = encoder.widest(design) if encoder.width > DENSE else range(1, 1)
                if used is None:
                    used = ~Normal(encoder.width, cells, sums, apart).redundant()
                    states[m][4] = used
                normal = Normal(encoder.width, cells, sums, apart, used)
                if deviance > old and abs(old - deviance) > tol * (abs(deviance) + 0.1) and turn < max_iter:
                    states[m][1] = (beta + before) / 2
                    continue
                step = normal.step(np.where(used, score, 0.0))
                if turn == max_iter or abs(old - deviance) <= tol * (abs(deviance) + 0.1):
                    gain = normal.gain(step)
                    if turn == max_iter or gain <= LEAST_STEP or gain > last / 10:
                        done[names[m]] = _model(design, encoder, beta, normal, size, means)
                        del states[m]
                        continue
                    states[m][5] = gain
                states[m][1:4] = [beta + step, beta, deviance]
            if not states:
                break
        return {n: done[n] for n in names}
    finally:
        rows.unpersist()


def _one_class(design: Design, n: int) -> LogitModel:
    return LogitModel(design, {INTERCEPT: math.nan}, {INTERCEPT: math.nan}, 0.0, 0.0, 2.0, n, tuple(design.names()))


def _model(design: Design, encoder: Encoder, beta: np.ndarray, normal: Normal, size: np.ndarray, means: Mapping[str, float]) -> LogitModel:
    variances, core = normal.covariance()
    # The intercept belongs to columns at 0, not at their means.
    shift = np.zeros(encoder.width)
    shift[0] = 1.0
    for term, mean in zip(encoder.terms, encoder.means):
        shift[term.start : term.start + 1] -= mean if term.size else 0.0
    shift = np.where(normal.used, shift, 0.0)
    names = [INTERCEPT, *design.names()]
    estimates = {n: float(b) for n, b, u in zip(names, beta, normal.used) if u}
    errors = {n: math.sqrt(v) for n, v, u in zip(names, variances, normal.used) if u}
    own = shift[normal.rest]
    estimates[INTERCEPT], errors[INTERCEPT] = float(shift @ beta), math.sqrt(float(own @ core @ own))
    n, positives, loss = int(size[0]), float(size[1]), float(size[2])
    null = -2.0 * sum(k * math.log(k / n) for k in (positives, n - positives) if k > 0)
    aliased = tuple(x for x, u in zip(names, normal.used) if not u)
    return LogitModel(design, estimates, errors, 2.0 * loss, null, 2.0 * loss + 2.0 * len(estimates), n, aliased)


def _level_pass(n: np.ndarray, s: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, information and Newton step of levels with ``n`` rows and ``s`` positives at their log odds."""
    p = 1.0 / (1.0 + np.exp(-eta))
    loss = n * (np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta)))) - s * eta
    weight = n * p * (1.0 - p)
    return loss, weight, np.divide(s - n * p, weight, out=np.zeros(len(n)), where=weight > 0)


def _log_odds(n: np.ndarray, s: np.ndarray, moves: Sequence[bool]) -> np.ndarray:
    """Where levels are after moves that all of them made: a Newton step, or half of the way back."""
    eta = before = np.zeros(len(n))
    for step in moves:
        if step:
            before, eta = eta, eta + _level_pass(n, s, eta)[2]
        else:
            eta = (eta + before) / 2
    return eta


def _level_sums(pairs: DataFrame | np.ndarray, moves: Sequence[bool], reference: tuple[float, float]) -> np.ndarray:
    """Rows, positives, loss and information of all levels, and the largest square of a column's step times its information."""
    first = tuple(np.array([x]) for x in reference)

    def sums(n: np.ndarray, s: np.ndarray, times: np.ndarray) -> list[float]:
        own = float(_level_pass(*first, _log_odds(*first, moves))[2][0])
        loss, weight, step = _level_pass(n, s, _log_odds(n, s, moves))
        gain = np.where(weight > 0, weight * (step - own) ** 2, 0.0).max(initial=0.0)
        # The reference's step is that of the intercept, whose information is everybody's.
        return [*[(times * x).sum() for x in (n, s, loss, weight)], gain, own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sums(*[batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "s", "times")])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in found], names)

    names = ["n", "s", "loss", "weight", "gain", "own"]
    if isinstance(pairs, np.ndarray):
        out = np.array(sums(*pairs))
    else:
        parts = pairs.mapInArrow(run, ", ".join(f"{c} double" for c in names))
        out = np.array([x or 0.0 for x in parts.agg(*[F.sum(c) for c in names[:4]], *[F.max(c) for c in names[4:]]).first()])
    out[4] = max(out[4], out[3] * out[5] ** 2)
    return out[:5]


def fit_long(df: DataFrame, design: Design, max_iter: int = 50, tol: float = 1e-10) -> LogitModel:
    """``fit_many`` of a single factor with a table of levels: the same steps and the same end, but no list of levels on the driver."""
    (name,), levels = design.features, design.long
    rows = df.select(_label(design.label), F.col(f"`{name}`").cast("string").alias("level")).filter("y IS NOT NULL AND NOT isnan(y) AND level IS NOT NULL")
    sums = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    known = levels.table.select("level").join(sums, "level", "left")
    counts = cut_lineage(known.select("level", F.coalesce("n", F.lit(0)).cast("double").alias("n"), F.coalesce("s", F.lit(0.0)).alias("s")))
    pairs = cut_lineage(counts.filter("n > 0").groupBy("n", "s").agg(F.count(F.lit(1)).alias("times")))
    if pairs.count() <= FEW_PAIRS:
        pairs = pairs.select("n", "s", "times").toPandas().to_numpy(float).T.reshape(3, -1)
    reference = tuple(counts.filter(F.col("level") == levels.reference).select("n", "s").first())
    moves: list[bool] = []
    old = last = math.inf
    for turn in range(max_iter + 1):
        size = _level_sums(pairs, moves, reference)
        deviance = 2.0 * size[2]
        if not 0 < size[1] < size[0]:
            return _long_model(design, counts, None, reference, size, 0.0)
        settled = abs(old - deviance) <= tol * (abs(deviance) + 0.1)
        if deviance > old and not settled and turn < max_iter:
            moves.append(False)
            continue
        if turn == max_iter or settled:
            if turn == max_iter or size[4] <= LEAST_STEP or size[4] > last / 10:
                break
            last = size[4]
        old = deviance
        moves.append(True)
    return _long_model(design, counts, moves, reference, size, deviance)


def _long_model(design: Design, counts: DataFrame, moves: Sequence[bool] | None, reference: tuple[float, float], size: np.ndarray, deviance: float) -> LogitModel:
    """The model of what each level has come to; without moves the labels are all the same, and no level has an estimate."""
    (name,), levels = design.features, design.long
    n, positives = int(size[0]), float(size[1])
    first = tuple(np.array([x]) for x in reference)
    seen = reference[0] > 0  # a reference without rows leaves the other levels their own log odds, and no intercept
    base, variance = (0.0, 0.0) if moves is None or not seen else (float(_log_odds(*first, moves)[0]), float(1.0 / _level_pass(*first, _log_odds(*first, moves))[1][0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "s"))
            none = rows <= 0 if moves is not None else np.ones(len(rows), bool)
            eta = _log_odds(rows, hits, moves or ())
            with np.errstate(divide="ignore"):
                error = np.sqrt(1.0 / _level_pass(rows, hits, eta)[1] + variance)
            terms = [f"{name}_{v}" for v in batch.column("level").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(eta - base, mask=none), pa.array(error, mask=none)], ["term", "estimate", "se"])

    others = counts.filter(F.col("level") != levels.reference)
    table = others.mapInArrow(run, "term string, estimate double, se double")
    empty = 0 if moves is None else others.filter("n <= 0").count()
    used = 0 if moves is None else len(levels) - 1 - empty
    gone = () if moves is None or seen else (INTERCEPT,)
    aliased = LongNames(table, gone, len(gone) + len(levels) - 1 - used)
    if moves is None:
        base, error, null = math.nan, math.nan, 0.0
    else:
        error, null = math.sqrt(variance), -2.0 * sum(k * math.log(k / n) for k in (positives, n - positives) if k > 0)
    estimates, errors = LongTerms(table, "estimate", used + 1, base), LongTerms(table, "se", used + 1, error)
    return LogitModel(design, estimates, errors, deviance, null, deviance + 2.0 * (used + 1), n, aliased, table)


def long_predictors(model: LogitModel) -> DataFrame:
    """``__level, __link``: the linear predictor of every level of a factor with a table of levels."""
    levels, (name,), base = model.design.long, model.design.features, model.estimates[INTERCEPT]
    others = model.table.select(F.substring("term", len(name) + 2, 2**31 - 1).alias("__level"), (F.lit(base) + F.coalesce("estimate", F.lit(0.0))).alias("__link"))
    return others.unionByName(others.sparkSession.createDataFrame([(levels.reference, base)], "__level string, __link double"))


def _beta(model: LogitModel) -> np.ndarray:
    return np.array([model.estimates.get(n, 0.0) for n in [INTERCEPT, *model.design.names()]])


def predictor(model: LogitModel) -> Column:
    """Linear predictor of a wide model; NULL for rows with a missing or unknown input."""
    design, beta = model.design, _beta(model)
    encoder = Encoder(design, {f: i for i, f in enumerate(design.features)})

    @F.arrow_udf("double")
    def walk(values: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(values.flatten(), names=[f"f{i}" for i in range(len(design.features))])
        index, value, complete = encoder.encode(batch)
        out = np.zeros(len(batch))
        out[complete] = _predict(beta, index, value)
        return pa.array(out, mask=~complete)

    return walk(F.struct(*[F.col(f"`{f}`").cast("string" if f in design.levels else "double").alias(f"f{i}") for i, f in enumerate(design.features)]))


def score_many(df: DataFrame, models: Mapping[str, LogitModel], digits: int, counted: DataFrame | None = None) -> DataFrame:
    """``model, y, score, n`` of the rows that each model can score; scores rounded, so that equal fits tie.

    A row stands for ``n`` equal ones: those of ``pattern_counts`` (``counted``, if they are there already) in countable designs, one row in others.
    """
    designs = {n: m.design for n, m in models.items()}
    grouped = {n for n, d in designs.items() if countable(d)}
    columns, places = _inputs(df, [d for n, d in designs.items() if n not in grouped])
    ready = {n: (Encoder(d, _keyed(d) if n in grouped else places), _beta(models[n])) for n, d in designs.items()}
    widths = {n: len(designs[n].features) for n in grouped}
    schema = "model string, y int, score double, n bigint"
    label = next(iter(designs.values())).label

    def scores(name: str, part: pa.RecordBatch, y: pa.Array, n: pa.Array) -> pa.RecordBatch:
        encoder, beta = ready[name]
        index, value, complete = encoder.encode(part)
        p = 1.0 / (1.0 + np.exp(-_predict(beta, index, value)))
        y, n = (c.filter(pa.array(complete)) for c in (y, n))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(p), pa.string()), y, pa.array(np.round(p, digits)), n], ["model", "y", "score", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in ready:
                if name not in grouped:
                    yield scores(name, batch, batch.column(0), pa.array(np.ones(len(batch), np.int64)))

    def run_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own, y, n in _by_model(batch, widths):
                yield scores(name, own, pa.array(y.astype(np.int32)), pa.array(n))

    out = []
    if len(grouped) < len(ready):
        rows = df.select(_label(label), *columns).filter("y IS NOT NULL").withColumn("y", F.col("y").cast("int"))
        out.append(rows.mapInArrow(run, schema))
    if grouped:
        counted = pattern_counts(df, label, countable_keys(designs)) if counted is None else counted
        out.append(counted.filter("y IS NOT NULL").mapInArrow(run_counted, schema))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
