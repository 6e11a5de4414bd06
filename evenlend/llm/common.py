"""Small helpers of the corpus operators: word splitting, row identity, numbering, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

# Fixed by the contract of the word-based operators: runs of digits, lower-case letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# A side that was counted at or under this many fixed-width rows is broadcast (about 100 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

__all__ = ["WORD", "UPPER", "cut_lineage", "lower_ascii", "words", "text_key", "small_side", "numbered", "held_out", "release_buffers", "free_names"]


def release_buffers() -> None:
    """Gives Arrow's unused buffers of a worker back to the machine; called between batches of texts."""
    pa.default_memory_pool().release_unused()


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for added columns, lengthened until no column of ``df`` has them (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is. Texts of ASCII only take the byte-wise path."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Array of words; a null text has none."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def text_key(text: Column) -> Column:
    """64-bit identity of a text; with the document's id it names a row up to exact repetition. Null is its own text."""
    return F.xxhash64(text.isNull(), text)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def small_side(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` marked for broadcast if a count proves that it is small; otherwise unmarked, and the join shuffles.

    Only for fixed-width columns and a table that is cheap to read again (a checkpoint or a small file).
    """
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each ``group`` in ``order``, without a task that holds a whole group.

    Rows are range-partitioned by group, order and their place in the input, so that equal keys spread too, and
    written once. A row's number is its index in its partition plus what earlier partitions hold of its group; the
    table of those offsets has at most one row per partition and group boundary.
    """
    place, first, before, pid = "__place", "__first", "__before", "__pid"
    spread = df.withColumn(place, F.monotonically_increasing_id())
    spread = spread.repartitionByRange(group, *order, place).sortWithinPartitions(group, *order, place)
    fixed = cut_lineage(spread.withColumn(place, F.monotonically_increasing_id()))
    fixed = fixed.withColumn(pid, F.shiftright(place, 33))
    counts = fixed.groupBy(group, pid).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias(first))
    earlier = Window.partitionBy(group).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, pid, first, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(before))
    joined = fixed.join(small_side(offsets), [group, pid])
    return joined.select(*df.columns, (F.col(place) - F.col(first) + F.col(before)).alias(name))
