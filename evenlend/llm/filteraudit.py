"""Operator 11: how filters interact, by a Gray-code walk over their subsets.

Every document gets a mask of the filters it fails. All that an audit needs is how many documents, good ones and toxic ones
each (part, mask) cell holds: 2^n cells a part, whatever the number of documents. The walk visits all subsets of the filters
in Gray order, so each move toggles one filter: it adds or takes one failure in the cells of that filter's masks, and only
cells whose counter of active failures leaves or reaches zero change the running survivors. The 2^n states are stored; a
step of an order is the difference of two of them, so no order is ever run.

Masks come from one pass over the texts, written once. The copy filter compares identities (SHA-256) of whole texts: the
smallest id of every distinct text is aggregated with map-side combining and joined back by id and identity, so thousands of
copies of one text never meet in a task. Labels join by id. Cells are summed map-side; the walk runs on the cells of many
parts at once, as arrays.

Defined cases: a null text is empty, a null source is the empty part; rows with a null id are counted, have no labels, fail no
copy filter and make no other row fail it; repeated rows (equal id and text) are all counted, as one another's equals; an id
with several label rows is good or toxic if any of them says so; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage

# Fixed by the contract: the filters' letters, in the order of their bits, and what each one fails.
FILTERS = "ABCDE"
COPY_BIT = FILTERS.index("E")
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # of 100 words
MOST_CAPITALS = 5  # of 100 code points
MARKS = r"[#$%&*|]"
PARTS_AT_ONCE = 64  # parts whose steps are written together


def text_failures(text: Column) -> list[Column]:
    """Whether a (not null) text fails A, B, C and D."""
    words = F.array_remove(F.split(text, SPACE), "")
    count = F.size(words)
    return [
        count < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * count,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        text.rlike(MARKS),
    ]


def _bits(failures: Sequence[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0))


def text_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, identity, mask``; the mask holds the failures that a text shows by itself."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    identity = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    return rows.select("doc_id", "part", identity.alias("identity"), _bits(text_failures(F.col("text"))).alias("mask"))


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` of every document, the copy filter included."""
    rows = cut_lineage(text_masks(docs))
    known = rows.filter("doc_id IS NOT NULL")
    first = known.groupBy("identity").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id")
    marks = marks.agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    # Sort-merge at every size: neither side is bounded.
    joined = known.join(first.hint("merge"), ["doc_id", "identity"], "left").join(marks.hint("merge"), "doc_id", "left")
    copy = F.when(F.col("first").isNull(), 1 << COPY_BIT).otherwise(0)
    marked = joined.select("part", (F.col("mask") + copy).alias("mask"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")])
    nameless = rows.filter("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return marked.unionByName(nameless)


def walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: ``cells[part, mask, measure]`` to ``states[part, subset, measure]``."""
    masks = np.arange(cells.shape[1])
    active = np.zeros(len(masks), np.int64)  # failures of each mask among the filters that are on
    states = np.zeros_like(cells)
    running = cells.sum(axis=1)
    states[:, 0] = running
    subset = 0
    for move in range(1, len(masks)):
        bit = (move & -move).bit_length() - 1
        subset ^= 1 << bit
        failing = (masks >> bit) & 1 == 1
        if subset >> bit & 1:
            active[failing] += 1
            running = running - cells[:, failing & (active == 1)].sum(axis=1)
        else:
            active[failing] -= 1
            running = running + cells[:, failing & (active == 0)].sum(axis=1)
        states[:, subset] = running
    return states


def steps(cells: np.ndarray, letters: str = FILTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Order and number of every step, and its counts per part; measures are documents, good ones, toxic ones."""
    n = len(letters)
    states = walk(cells)
    orders = list(permutations(range(n)))
    named = [("".join(letters[f] for f in order), i + 1) for order in orders for i in range(n)]
    which = np.array([f for order in orders for f in order])
    before = np.array([sum(1 << f for f in order[:i]) for order in orders for i in range(n)])
    after = before | (1 << which)
    masks = np.arange(cells.shape[1])
    fails = np.stack([cells[:, (masks >> f) & 1 == 1, 0].sum(axis=1) for f in range(n)], axis=1)
    alone = np.stack([cells[:, 1 << f, 0] for f in range(n)], axis=1)
    lost = states[:, before] - states[:, after]
    removed = lost[:, :, 0]
    shapley = np.stack([removed[:, which == f].sum(axis=1) for f in range(n)], axis=1)
    return named, {
        "kept": states[:, after, 0],
        "removed": removed,
        "redundant": fails[:, which] - removed,
        "unique_fails": alone[:, which],
        "good_lost": lost[:, :, 1],
        "toxic_lost": lost[:, :, 2],
        "shapley": shapley[:, which],
    }


def audit(masks: DataFrame, letters: str = FILTERS) -> DataFrame:
    """All steps of all orders per part, from ``part, mask, good, toxic`` rows.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.
    """
    cells = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").cast("bigint").alias("good"), F.sum("toxic").cast("bigint").alias("toxic")
    )
    # At most 2^n cells a part.
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    size = 1 << len(letters)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), PARTS_AT_ONCE):
                part = frame.iloc[at : at + PARTS_AT_ONCE]
                table = np.zeros((len(part), size, 3), np.int64)
                for i, own in enumerate(part["cells"]):
                    for cell in own:
                        table[i, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                named, counts = steps(table, letters)
                out = {
                    "part": np.repeat(part["part"].to_numpy(), len(named)),
                    "filter_order": [order for order, _ in named] * len(part),
                    "step": np.tile(np.array([i for _, i in named], np.int32), len(part)),
                }
                yield pd.DataFrame(out | {name: values.ravel() for name, values in counts.items()})

    kinds = ", ".join(f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return held.mapInPandas(run, f"part string, filter_order string, step int, {kinds}")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five fixed filters over whole texts."""
    return audit(document_masks(docs, labels))
