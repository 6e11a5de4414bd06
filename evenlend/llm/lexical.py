"""Operator 12: ranked lexical search as dense blocked matrix products.

Queries (items) are a stated set, taken in blocks whose texts are bounded (``BLOCK_CHARS``). Per block, one pass over the
texts writes a sparse row per document: its number of terms and the places in the block's vocabulary that it holds, with
their counts. Corpus counts (documents, terms, documents per term) are aggregated from those rows by Spark; one number per
vocabulary term reaches the driver.

Scoring multiplies tiles. An item tile holds at most ``ITEM_TILE`` items and, slice by slice, the terms that those items use:
a compact dense matrix of weights. A document tile holds the impacts of ``DOC_TILE`` documents on those of the slice's terms that
occur in the tile. Both are float64, and their product goes to BLAS. Slices end before the weights of an item could
bring a partial sum to 2^53 at the largest possible impact, so every product is an exact integer; slices are added as 64-bit integers.

Top-k: each tile keeps its scores at or above the k-th best of the tile and of the task so far, ties included, and the pool is cut
by (score, id). A task sends at most k rows an item, and Spark ranks what the tasks sent. No score is lost to a tie.

Defined cases: null texts and texts without a term count as no document and are never found; null ids stay and come last among equal scores;
repeated document rows are documents each; equal items (id and text) are one, equal ids with different texts are items of
their own with ranks of their own; items without a term, or without a document of score above 0, give no rows; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage, release_buffers

# Fixed by the contract: what separates terms, and the constants of weight and impact.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
MOST_IMPACT = 1_000_000  # SCALE * tf div (1000 * tf + ...) stays below it

BLOCK_CHARS = 16_000_000
ITEM_TILE = 64
TERM_TILE = 4096
DOC_TILE = 1024
TEXT_BYTES = 8 << 20  # text split at a time
EXACT = 2**53
_TERM = re.compile(TERM)


def split_terms(text: str | None) -> list[str]:
    """Plain splitting, for items; documents are split by ``count_batch``."""
    return [t.translate(_LOWER) for t in _TERM.findall(text)] if text else []


_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``TEXT_BYTES`` together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


def count_batch(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text, then row, vocabulary place and count of every (text, vocabulary term) that occurs."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=SEPARATORS)
    rows = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(parts)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    total = np.bincount(rows[real], minlength=len(texts)).astype(np.int64)
    found = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    hit = found >= 0
    keys, counts = np.unique(rows[hit] * len(vocabulary) + found[hit], return_counts=True)
    return total, keys // max(1, len(vocabulary)), (keys % max(1, len(vocabulary))).astype(np.int32), counts


def sparse_rows(docs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document with a term; ``terms`` are places in the vocabulary."""
    words = list(vocabulary)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                total, row, term, count = count_batch(texts, known)
                offsets = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((term, pa.int32()), (count, pa.int64()))]
                out = [batch.column(0).slice(at, len(texts)), pa.array(total), *lists]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "terms", "counts"]).filter(pa.array(total > 0))
                release_buffers()

    schema = f"doc_id {kind}, n bigint, terms array<int>, counts array<bigint>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Corpus:
    documents: int
    terms: int

    def middle(self, n: np.ndarray) -> np.ndarray:
        """The length part of the impact; lengths beyond 64 bits in between are computed one by one."""
        safe = (2**63 - 1) // (25 * max(1, self.documents))
        out = 25 * np.minimum(n, safe) * self.documents // max(1, self.terms)
        for i in np.flatnonzero(n > safe):
            out[i] = 25 * int(n[i]) * self.documents // self.terms
        return 75 + out

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Slice:
    """Some terms of an item tile: their places in the vocabulary, and items x terms of exact float64 weights."""

    terms: np.ndarray
    weights: np.ndarray


def item_tiles(counts: Sequence[Counter], weights: np.ndarray) -> list[tuple[int, list[Slice]]]:
    """Tiles of consecutive items: the first item and the slices. ``counts`` are occurrences per vocabulary place."""
    room = (EXACT - 1) // MOST_IMPACT
    tiles = []
    for first in range(0, len(counts), ITEM_TILE):
        part = counts[first : first + ITEM_TILE]
        slices, columns, load = [], [], np.zeros(len(part), np.int64)

        def close() -> None:
            if columns:
                terms, values = zip(*columns)
                slices.append(Slice(np.array(terms), np.stack(values, axis=1).astype(np.float64)))
            columns.clear()
            load[:] = 0

        for term in sorted({t for c in part for t in c}):
            left = np.array([c.get(term, 0) for c in part], np.int64) * weights[term]
            while left.any():  # more than one round only for a term that alone would pass the bound
                now = np.minimum(left, room)
                if len(columns) == TERM_TILE or (load + now > room).any():
                    close()
                columns.append((term, now))
                load += now
                left = left - now
        close()
        tiles.append((first, slices))
    return tiles


class Pool:
    """The k best documents of every item, ties to the smaller id, nulls last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)  # scores under ``least`` cannot enter
        self.kept: pa.Table | None = None

    def offer(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of consecutive items (rows) for documents (columns)."""
        n = scores.shape[1]
        own = slice(first, first + len(scores))
        kth = np.partition(scores, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.ones(len(scores), np.int64)
        item, column = np.nonzero(scores >= np.maximum(kth, self.least[own])[:, None])
        if not len(item):
            return
        new = pa.table({"item": pa.array(item + first), "score": pa.array(scores[item, column]), "doc_id": ids.take(pa.array(column))})
        self.kept = new if self.kept is None else pa.concat_tables([self.kept, new])
        if self.kept.num_rows > 4 * self.k * len(self.least):
            self.cut()

    def cut(self) -> pa.Table | None:
        if self.kept is None:
            return None
        order = [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
        table = self.kept.take(pc.sort_indices(self.kept, order, null_placement="at_end"))
        item = table["item"].to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.kept = table.filter(pa.array(place < self.k)).combine_chunks()
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.kept["item"].to_numpy()[last]] = self.kept["score"].to_numpy()[last]
        return self.kept


def tile_scores(slices: Sequence[Slice], items: int, docs: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """Exact scores, items x documents, of a tile of documents given as (document, vocabulary place, impact)."""
    total = np.zeros((items, docs), np.int64)
    for part in slices:
        at = np.minimum(np.searchsorted(part.terms, term), len(part.terms) - 1)
        hit = part.terms[at] == term
        if not hit.any():
            continue
        used, place = np.unique(at[hit], return_inverse=True)
        dense = np.zeros((len(used), docs))
        dense[place, row[hit]] = impact[hit]
        total += (part.weights[:, used] @ dense).astype(np.int64)
    return total


def _search(rows: DataFrame, corpus: Corpus, tiles: list[tuple[int, list[Slice]]], items: int, k: int) -> DataFrame:
    """``item, doc_id, score``: at most k documents an item and task."""
    kind = dict(rows.dtypes)["doc_id"]
    shared = rows.sparkSession.sparkContext.broadcast(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(items, k)
        for batch in batches:
            for at in range(0, len(batch), DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                terms, counts = part.column(2), part.column(3)
                row = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64)
                term, tf = (pc.list_flatten(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, counts))
                middle = corpus.middle(part.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
                impact = SCALE * tf // (1000 * tf + 12 * middle[row])
                for first, slices in shared.value:
                    pool.offer(first, tile_scores(slices, min(ITEM_TILE, items - first), len(part), row, term, impact), part.column(0))
        kept = pool.cut()
        if kept is not None:
            yield from kept.select(["item", "doc_id", "score"]).to_batches()

    return rows.mapInArrow(run, f"item bigint, doc_id {kind}, score bigint")


def _block(docs: DataFrame, items: list[tuple[object, str]], kind: str, k: int) -> DataFrame | None:
    """``item_id, rank, doc_id, score`` of one block of items."""
    spark = docs.sparkSession
    counted = [Counter(split_terms(text)) for _, text in items]
    vocabulary = sorted({t for c in counted for t in c})
    if not vocabulary:
        return None
    rows = cut_lineage(sparse_rows(docs, vocabulary))
    size = rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    if not size["documents"]:
        return None
    corpus = Corpus(size["documents"], size["terms"])
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["t"]] = r["n"]
    weights = np.array([corpus.weight(int(n)) for n in df], np.int64)
    places = {t: i for i, t in enumerate(vocabulary)}
    tiles = item_tiles([Counter({places[t]: n for t, n in c.items()}) for c in counted], weights)
    found = _search(rows, corpus, tiles, len(items), k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], f"item bigint, item_id {kind}")
    # One row per item of the block, whose texts are bounded.
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents. Blocks of items of about ``block_chars`` are ranked in turn."""
    kinds, spark = dict(items.dtypes), docs.sparkSession
    wanted = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    chars = wanted.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    out = None
    for b in range(blocks):
        own = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        found = _block(docs, sorted(((r["item_id"], r["text"]) for r in own), key=repr), kinds["item_id"], k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score bigint")
    return out
