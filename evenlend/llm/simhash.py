"""Operator 8: SimHash near-duplicates through a hierarchical index in Gray order.

A document's fingerprint has a bit set where more than half of its shingle hashes have it. Fingerprints link at
``max_bits`` or fewer differing bits.

The index is a tree of masked bit patterns. Its upper nodes are masks over ``f`` disjoint bit fields, ``f - max_bits`` of them
together: two linked fingerprints agree in that many fields at least, so below a node (mask, pattern) all members have accumulated
no difference there, and a pair is looked at under the first mask it agrees in only. ``f`` grows with the number of fingerprints
until a node is expected to hold no more than a task takes: 5 fields give 5 masks of 12 or 13 bits, 6 give 15 of 21, 7 give 35 of
27, 8 give 70 of 32. Members of a node are sorted by Gray rank, in which neighbours differ in few bits. Runs of ``LEAF`` neighbours
form the leaves, ``FAN`` nodes of a level one node of the level above; a node keeps the mask and the pattern of the bits that all below
it share and that no node above it has. A run of fingerprints descends the tree, adding up its differences from the patterns on
the way; a group whose sum exceeds ``max_bits`` is pruned whole, only the members of leaves that are reached are compared bit by bit.

Only distinct fingerprints enter, so copies cost one row per task before the first shuffle. A node with more than
``NODE_ROWS`` members is dealt into blocks by a hash, and pairs of blocks are separate units of work. Inside a unit links
are reduced to a spanning forest before they leave the task, so no quadratic number of pairs is written. Links of all units then
go through ``components``.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like any other; a
text of fewer words than a shingle is one shingle; null ids take part but are not the smallest id while another exists;
repeated rows give one row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, free_names, release_buffers, small_side, text_key
from .components import components

BITS = 64
MAX_BITS = 4
WORDS = 4
NODE_ROWS = 2048
LEAF = 32
FAN = 8
SEED = 42


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space, shingles of ``size`` words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[size - 1 :].tolist() if len(found) >= size else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the 64-bit hashes have."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = counts * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """``doc_id, text_key, fp``; ``fp`` is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_key", "fp"])
            release_buffers()

    narrow = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, text_key bigint, fp bigint")


def fields(count: int) -> list[int]:
    """Masks of ``count`` disjoint bit fields that cover all bits."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def masks(count: int, max_bits: int = MAX_BITS) -> list[int]:
    """Unions of ``count - max_bits`` fields; two fingerprints within ``max_bits`` bits agree in one of them."""
    return [sum(chosen) for chosen in combinations(fields(count), count - max_bits)]


def field_count(rows: int, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> int:
    """The least number of fields whose nodes hold ``node_rows`` or fewer of ``rows`` evenly spread fingerprints."""
    for count in range(max_bits + 1, 2 * max_bits + 1):
        if rows <= node_rows << min(m.bit_count() for m in masks(count, max_bits)):
            return count
    return 2 * max_bits + 1


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class _Level:
    """Nodes of one level: the first child of each, and the mask and pattern of the bits that all below a node share."""

    def __init__(self, starts: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.starts, self.ones, self.zeros = starts, ones, zeros
        self.own = ones | zeros  # less the bits of the nodes above, once those are known


def _tree(codes: np.ndarray) -> list[_Level]:
    """Levels from the leaves up to a single node, over codes in Gray order."""
    starts = np.arange(0, len(codes), LEAF)
    levels = [_Level(starts, np.bitwise_and.reduceat(codes, starts), np.bitwise_and.reduceat(~codes, starts))]
    while len(levels[-1].starts) > 1:
        below = levels[-1]
        starts = np.arange(0, len(below.starts), FAN)
        levels.append(_Level(starts, np.bitwise_and.reduceat(below.ones, starts), np.bitwise_and.reduceat(below.zeros, starts)))
        above = levels[-1].ones | levels[-1].zeros
        below.own = below.own & ~np.repeat(above, FAN)[: len(below.starts)]
    return levels


def _reached(levels: list[_Level], leaf: int, limit: int) -> np.ndarray:
    """Leaves from ``leaf`` on that no sum of differences from ``leaf``'s shared bits rules out."""
    pattern, mask = levels[0].ones[leaf], levels[0].ones[leaf] | levels[0].zeros[leaf]
    nodes, apart = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        if depth < len(levels) - 1:
            nodes, apart = (nodes[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(apart, FAN)
            later = (nodes < len(level.starts)) & (nodes >= leaf // FAN**depth)  # a pair is looked at from its earlier run
            nodes, apart = nodes[later], apart[later]
        apart = apart + np.bitwise_count((pattern ^ level.ones[nodes]) & mask & level.own[nodes])
        near = apart <= limit
        nodes, apart = nodes[near], apart[near]
    return nodes


class _Forest:
    """Union-find over positions; the smaller position is the root."""

    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def linked_pairs(codes: np.ndarray, side: np.ndarray, within: bool, earlier: list[int], max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs among codes in Gray order; ``side`` 0 or 1 is the block, ``within`` allows pairs of one block.

    Pairs that agree in one of the ``earlier`` masks are left to that mask's node.
    """
    limit = np.uint8(max_bits)
    levels = _tree(codes)
    starts = levels[0].starts
    lengths = np.diff([*starts, len(codes)])
    inside = np.arange(LEAF)
    for i in range(len(starts)):
        near = _reached(levels, i, max_bits)
        left = np.arange(starts[i], starts[i] + lengths[i])
        right = (starts[near][:, None] + inside)[inside < lengths[near][:, None]]
        different = codes[left][:, None] ^ codes[right][None, :]
        hit = (np.bitwise_count(different) <= limit) & (left[:, None] < right[None, :])
        if not within:
            hit &= side[left][:, None] != side[right][None, :]
        x, y = np.nonzero(hit)
        if len(x):
            ok = np.ones(len(x), dtype=bool)
            for m in earlier:
                ok &= (different[x, y] & np.uint64(m)) != 0
            yield left[x[ok]], right[y[ok]]


def _unit_links(codes: np.ndarray, side: np.ndarray, within: bool, earlier: list[int], max_bits: int, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of one unit: members and their roots, with ``direct`` pairs that are linked themselves."""
    order = np.argsort(gray_rank(codes), kind="stable")
    codes, side = codes[order], side[order]
    forest = _Forest(len(codes))
    touched, pairs = False, []
    for x, y in linked_pairs(codes, side, within, earlier, max_bits):
        for a, b in zip(x.tolist(), y.tolist()):
            if direct and forest.root(a) != forest.root(b):
                pairs.append((a, b))
            forest.join(a, b)
            touched = True
    if not touched:
        return codes[:0], codes[:0]
    if direct:
        return codes[[a for a, _ in pairs]], codes[[b for _, b in pairs]]
    roots = np.array([forest.root(i) for i in range(len(codes))])
    moved = roots != np.arange(len(codes))
    return codes[moved], codes[roots[moved]]


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS, count: int | None = None, direct: bool = False) -> DataFrame:
    """``a, b``: links that connect all fingerprints (column ``fp``, distinct) at ``max_bits`` or fewer differing bits.

    ``count`` is the number of bit fields; by default it follows from the number of fingerprints. With ``direct`` every
    pair is within ``max_bits`` itself; else a pair may be joined by others of its node.
    """
    parts = masks(count or field_count(fps.count(), max_bits, node_rows), max_bits)
    each = [F.struct(F.lit(j).alias("field"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern")) for j, m in enumerate(parts)]
    placed = fps.select("fp", F.explode(F.array(*each)).alias("k")).select("fp", "k.field", "k.pattern")
    counts = placed.groupBy("field", "pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > node_rows)
    large = cut_lineage(counts.select("field", "pattern", F.ceil(F.col("n") / node_rows).cast("int").alias("blocks")))
    dealt = placed.join(small_side(large), ["field", "pattern"], "left").fillna(1, ["blocks"])
    block = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    dealt = dealt.select("fp", "field", "pattern", "blocks", block.alias("block"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    unit = dealt.select(
        "field", "pattern", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp",
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    key = ["field", "pattern", "lo", "hi"]
    sorted_units = unit.repartition(*key).sortWithinPartitions(*key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(part: pd.DataFrame) -> pd.DataFrame:
            codes = part["fp"].to_numpy(np.int64).view(np.uint64)
            within = bool(part["lo"].iat[0] == part["hi"].iat[0])
            a, b = _unit_links(codes, part["side"].to_numpy(), within, parts[: int(part["field"].iat[0])], max_bits, direct)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        held = None  # the last unit of a batch may go on in the next
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            at = np.flatnonzero((frame[key].to_numpy()[1:] != frame[key].to_numpy()[:-1]).any(axis=1)) + 1
            bounds = [0, *at.tolist(), len(frame)]
            done = [solve(frame.iloc[a:b]) for a, b in zip(bounds, bounds[1:-1]) if b - a > 1]
            held = frame.iloc[bounds[-2] :]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None and len(held) > 1:
            yield solve(held)

    return sorted_units.mapInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, size: int = WORDS) -> DataFrame:
    """Per document: ``doc_id, text_key, fp, component_id``, the smallest id of its connected group."""
    prints = cut_lineage(fingerprints(docs, size))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(fingerprint_links(distinct.select("fp"), max_bits), "a", "b")
    grouped = distinct.join(groups, distinct["fp"] == groups["node"], "left")
    grouped = grouped.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, size: int = WORDS) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Of repeated ids within a group the smallest text hash stays, of fully repeated rows one.
    """
    groups = near_duplicates(docs, max_bits, size)
    pick = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("text_key"))
    # A group of null ids only has no component id; its fingerprint tells it apart.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")]
    own_id, own_text, key = free_names(docs, "__id", "__text", "__key")
    stays = groups.groupBy(*group).agg(F.min(pick).alias("p")).select(F.col("p.doc_id").alias(own_id), F.col("p.text_key").alias(own_text))
    keyed = docs.withColumn(key, text_key(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_text))
    return keyed.join(stays, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
