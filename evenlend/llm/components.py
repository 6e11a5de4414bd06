"""Connected components of a link table, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage

# Links at or under this number (fixed width, about 2 MB) are counted, then star steps need no exchange among them.
FEW_LINKS = 100_000


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step on edges ``a > b``: every node's neighbours are hung on the smallest of them.

    The large step moves the neighbours above a node, the small step those below it and the node itself. Minima are
    aggregated before the shuffle and joined back, so a node with many neighbours is never one task's list.
    """
    if larger_only:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = [F.struct(F.col(node).alias("a"), F.col("m").alias("b")) for node in ("a", "b")]
        out = edges.join(least, "a").select(F.inline(F.array(*hung)))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, left: str, right: str, few: int = FEW_LINKS) -> DataFrame:
    """``node, component`` for every node of a link, ``component`` being the smallest node reachable.

    Self links and repeated links change nothing. Every round is written to the checkpoint folder; rounds end when the
    stars no longer change, after a number of rounds logarithmic in the size of the longest chain. At most ``few`` links make
    their rounds in one partition, else each of a dozen shuffles a round would write files for every partition.
    """
    a, b = F.col(left), F.col(right)
    edges = links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = cut_lineage(edges)
    seen = None
    while True:
        now = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == seen:
            break
        seen = now
        edges = edges.coalesce(1) if now[0] <= few else edges
        edges = cut_lineage(_star(_star(edges, True), False))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
