"""Operator 2: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

1. Every labelled row outside the held-out quarter counts: for each hashed n-gram the number of toxic and of other texts
   that contain it. The log ratio of the smoothed shares is the n-gram's scale.
2. Every bucket is a feature at every size of the table: a text's feature is the ratio if it contains the n-gram, else 0;
   buckets that no labelled row has are 0.
3. A ridge logistic regression is fitted on a bounded sample of about ``SAMPLE_ROWS`` labelled rows, taken by a hash.
4. Every whole text is scored in one pass without a shuffle.

Texts are not shuffled while the labelled ids are few enough to be broadcast (counted); beyond that the texts that may be
learned from are joined by id once for the counts, and their sample once more for the fit.

Counts and weights have one entry per hash bucket (``2 ** BUCKET_BITS``), so the model has a fixed size.

Defined cases: null and empty texts get the score of a text without any n-gram; without labelled rows, or with one
class only, the score is that class's smoothed share; null ids count as the empty id and stay; labels that are null or
of unknown ids are not used, of repeated labels the larger holds; repeated rows give one row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, held_out, small_side, text_key

SIZES = (3, 4, 5)
BUCKET_BITS = 20
SAMPLE_ROWS = 8000
RIDGE = 1.0
THRESHOLD = 0.3
_SPREAD = np.uint32(2654435761)
_STEP = np.uint32(16777619)


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of all character n-grams of the lower-cased text, padded by a space on both sides; with repeats."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, rolling = [], codes * _SPREAD
    for size in range(2, max(SIZES) + 1):
        rolling = rolling[:-1] * _STEP ^ codes[size - 1 :] * _SPREAD
        if size in SIZES:
            out.append((rolling ^ (rolling >> np.uint32(15))) * _SPREAD >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


def _labelled(docs: DataFrame, labels: DataFrame, share: float = 1.0) -> DataFrame:
    """``toxic, text`` of labelled rows that may be learned from; ``share`` of them by a hash of the row."""
    rows = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if share < 1:
        drawn = F.pmod(F.xxhash64("doc_id", text_key(F.col("text"))), F.lit(1 << 30))
        rows = rows.filter(drawn < int(share * (1 << 30)))
    marks = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.join(small_side(cut_lineage(marks)), "doc_id").select("toxic", "text")


def distinct_buckets(text: str | None) -> np.ndarray:
    """The buckets of ``text`` once each; its last occurrence counts."""
    found = buckets(text)
    order = np.arange(len(found), dtype=np.int32)
    if len(found) < 1 << 14:
        return np.unique(found)
    last = np.empty(1 << BUCKET_BITS, dtype=np.int32)
    last[found] = order
    return found[last[found] == order]


@dataclass
class Model:
    weights: np.ndarray  # of each bucket
    bias: float

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + self.weights[distinct_buckets(text)].sum(), -700, 700))))


def ngram_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Texts per bucket without and with the label, and the number of texts of each kind, over all labelled rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, (1 << BUCKET_BITS) + 1), dtype=np.int64)  # the last entry counts texts
        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1)):
                row = held[int(toxic.as_py() > 0)]
                row[np.unique(buckets(text.as_py()))] += 1
                row[-1] += 1
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[0, at]), pa.array(held[1, at])], ["bucket", "clean", "toxic"])

    counted = _labelled(docs, labels).mapInArrow(count, "bucket bigint, clean bigint, toxic bigint")
    summed = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    held = np.zeros((2, (1 << BUCKET_BITS) + 1), dtype=np.int64)
    held[0, summed["bucket"]], held[1, summed["bucket"]] = summed["clean"], summed["toxic"]
    return held[0, :-1], held[1, :-1], (int(held[0, -1]), int(held[1, -1]))


def log_ratios(clean: np.ndarray, toxic: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """Log-count ratio of every bucket, 0 where no labelled row has it."""
    ratio = np.log((toxic + 1) / (texts[1] + 2)) - np.log((clean + 1) / (texts[0] + 2))
    return np.where(clean + toxic > 0, ratio, 0.0)


class _Sparse:
    """Rows of bucket lists, scaled by the buckets' ratios, and a constant last column; products go in bounded chunks."""

    def __init__(self, at: list[np.ndarray], ratio: np.ndarray) -> None:
        self.ratio, self.sizes = ratio, np.array([len(a) for a in at], dtype=np.int64)
        self.at = np.concatenate(at) if at else np.empty(0, dtype=np.int32)
        self.ends = np.cumsum(self.sizes)
        self.cuts = np.unique(np.append(np.searchsorted(self.ends, np.arange(0, len(self.at), 1 << 20)), [0, len(at)]))

    def _chunks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for a, b in zip(self.cuts, self.cuts[1:]):
            yield a, b, self.at[self.ends[a] - self.sizes[a] : self.ends[b - 1]]

    def dot(self, w: np.ndarray) -> np.ndarray:
        scaled, out = w[:-1] * self.ratio, np.zeros(len(self.sizes))
        for a, b, at in self._chunks():
            rows = a + np.flatnonzero(self.sizes[a:b])
            if len(rows):
                out[rows] = np.add.reduceat(scaled[at], self.ends[rows] - self.sizes[rows] - (self.ends[a] - self.sizes[a]))
        return out + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ratio))
        for a, b, at in self._chunks():
            out += np.bincount(at, np.repeat(r[a:b], self.sizes[a:b]), len(out))
        return np.append(out * self.ratio, r.sum())


def _fit(x: _Sparse, y: np.ndarray, rounds: int = 30, inner: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps with conjugate gradients; the last column of ``x`` is the free constant."""
    w = np.zeros(len(x.ratio) + 1)
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 0.0
    at = np.zeros(len(y))
    loss = lambda a, v: np.logaddexp(0, a).sum() - y @ a + 0.5 * (ridge * v * v).sum()
    for t in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(at, -500, 500)))
        slope = x.back(p - y) + ridge * w
        size = np.linalg.norm(slope)
        first = size if t == 0 else first
        if size <= 1e-5 * first:
            break
        step, rest, curve = np.zeros(len(w)), slope.copy(), p * (1 - p)
        along, left = rest.copy(), rest @ rest
        for _ in range(inner):
            turned = x.back(curve * x.dot(along)) + ridge * along
            bend = along @ turned
            if bend <= 0:
                break
            step += left / bend * along
            rest -= left / bend * turned
            now = rest @ rest
            if np.sqrt(now) <= min(0.1, np.sqrt(size / first)) * size:
                break
            along, left = rest + now / left * along, now
        moved, share, before = x.dot(step), 1.0, loss(at, w)
        while share > 1e-4 and loss(at - share * moved, w - share * step) > before - 1e-4 * share * (slope @ step):
            share /= 2
        if share <= 1e-4:
            break
        w, at = w - share * step, at - share * moved
    return w


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    clean, toxic, texts = ngram_counts(docs, labels)
    ratio = log_ratios(clean, toxic, texts)
    if min(texts) == 0:
        odds = (texts[1] + 0.5) / (texts[0] + 0.5)
        return Model(np.zeros_like(ratio), float(np.log(odds)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_buckets(t.as_py()).astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["toxic", "at"])

    # Written by all tasks and read part by part, so the driver holds the sample once.
    sample = cut_lineage(_labelled(docs, labels, sample_rows / sum(texts)).mapInArrow(encode, "toxic int, at binary"))
    marks, at = [], []
    for row in sample.toLocalIterator():
        marks.append(float(row["toxic"] > 0))
        at.append(np.frombuffer(row["at"], dtype="<i4"))
    # The columns that the sample has; every other weight of a ridge fit is 0.
    used = np.zeros(len(ratio), dtype=bool)
    for a in at:
        used[a] = True
    columns = np.flatnonzero(used)
    place = np.zeros(len(ratio), dtype=np.int32)
    place[columns] = np.arange(len(columns))
    at, y = [place[a] for a in at], np.array(marks)
    if y.min(initial=1) == y.max(initial=0):
        y = np.append(y, [0.0, 1.0])
        at += [np.empty(0, dtype=np.int32)] * 2
    w = _fit(_Sparse(at, ratio[columns]), y)
    weights = np.zeros_like(ratio)
    weights[columns] = w[:-1] * ratio[columns]
    return Model(weights, float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            scores = pa.array([held.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs, learn(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
