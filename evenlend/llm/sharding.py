"""Operator 9: shards by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A row descends it: at each level every child draws ``ln(u) / weight`` with ``u``
a uniform number hashed from the row's key and the child's name, and the largest draw wins, so a child gets its share of
the weights below the node. A change of one weight moves rows only between the changed child and its siblings, and only
along the path of nodes whose weights changed. A shard added by ``grow`` joins as a region of its own: no other subtree
changes its weight, hence rows move into the new shard only.

Everything is column expressions; the tree is a literal of the plan, only the children of the chosen nodes draw, and rows
never move for it.

Defined cases: a null id is a key of its own, repeated ids go to the same shard, a null text has size 1 and the checksum
of no bytes, an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered

DRAW_BITS = 52


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int = 16, racks_per_region: int = 2, shards_per_rack: int = 2) -> list[Shard]:
    """Shards of equal weight, filled rack by rack and region by region."""
    racks = [s // shards_per_rack for s in range(shards)]
    return [Shard(f"r{k // racks_per_region}", f"k{k}", s) for s, k in enumerate(racks)]


def grow(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own."""
    new = 1 + max((s.shard for s in tree), default=-1)
    return [*tree, Shard(f"r+{new}", f"k+{new}", new, weight)]


def _draw(key: Column, child: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit("|"), child["name"]).cast("binary")), 1, DRAW_BITS // 4)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**DRAW_BITS)
    return F.log(unit) / child["weight"]


def _children(children: Sequence[tuple[str, float, int]]) -> Column:
    """Name, weight and number of each child."""
    each = [F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(-i).alias("order"), F.lit(v).alias("next")) for i, (n, w, v) in enumerate(children)]
    return F.array(*each)


def _winner(key: Column, children: Column) -> Column:
    """The number of the child with the largest draw; equal draws go to the child named first."""
    drawn = F.transform(children, lambda c: F.struct(_draw(key, c).alias("draw"), c["order"].alias("order"), c["next"].alias("next")))
    return F.array_max(drawn)["next"]


def place(df: DataFrame, tree: Sequence[Shard], id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """Adds the shard of every row, decided by its id and the tree alone. Shards of weight 0 get nothing."""
    live = sorted((s for s in tree if s.weight > 0), key=lambda s: (s.region, s.rack, s.shard))
    if not live:
        raise ValueError("the tree has no shard with a weight")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    regions = sorted({s.region for s in live})
    racks = sorted({(s.region, s.rack) for s in live})
    weigh = lambda **at: sum(s.weight for s in live if all(getattr(s, k) == v for k, v in at.items()))
    top = _children([(f"region {r}", weigh(region=r), i) for i, r in enumerate(regions)])
    middle = F.array(*[
        _children([(f"rack {r}/{k}", weigh(region=r, rack=k), i) for i, (of, k) in enumerate(racks) if of == r]) for r in regions
    ])
    leaves = F.array(*[
        _children([(f"shard {r}/{k}/{s.shard}", s.weight, s.shard) for s in live if (s.region, s.rack) == (r, k)]) for r, k in racks
    ])
    step = df.withColumn("__region", _winner(key, top))
    step = step.withColumn("__rack", _winner(key, F.get(middle, F.col("__region"))))
    return step.withColumn(out, _winner(key, F.get(leaves, F.col("__rack")))).drop("__region", "__rack")


def assign(docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard] | None = None) -> DataFrame:
    """Per document: size, checksum, shard, gapless slot within the shard (in order of id), and the shard in ``grown``."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = place(narrow, tree)
    placed = place(placed, grown, out="grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    return numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")
