"""Operator 3: benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window), and every window
into shingles of ``shingle`` consecutive words (a shorter window is one shingle). A window occurs in a document exactly
if the document contains all its shingles at the right distances (containment 1).

1. One scan of the documents hashes their shingles and keeps the ones that some window has (``hits``, with positions).
   These also give the corpus frequency of every shingle, which is the global order: rarest first.
2. At containment 1 the necessary prefix of a window is its one rarest shingle. Only it is joined; windows with a
   shingle that never occurs are dropped before.
3. Length and positional bounds: the window must start at or after the first word and end at or before the last.
4. What is left is verified: shingles that cover the window must be hits at their exact places.

Only DataFrame functions run. The benchmark side is broadcast if a count proves it small, else the same join shuffles and
adaptive execution splits hot shingles. A row is known by its id and a 64-bit hash of its text.

Defined cases: null and empty texts have no words and no hits, on both sides; null ids are kept; repeated rows give one
row each; an item occurring through several windows counts once; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, free_names, small_side, text_key, words

WINDOW = 10
SHINGLE = 5
END = "__end"  # the marker that every document has once, so that documents without hits stay
KEY = ["doc_id", "text_key"]


def _shingle(array: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(array, at + j) for j in range(size)])


def _placed_shingle(array: Column, size: int, at: Column) -> Column:
    return F.struct(at.alias("pos"), _shingle(array, at, size).alias("sh"))


def _marker() -> Column:
    return F.xxhash64(F.lit(END))


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``item_id, win, n, size, at, sh``: one row per distinct item window and shingle; ``win`` is the window's words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = items.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("start"))
    cut = starts.select("item_id", "n", F.slice("w", F.col("start") + 1, F.col("n")).alias("w"))
    cut = cut.select("item_id", F.array_join("w", " ").alias("win"), "n", "w").dropDuplicates(["item_id", "win"])
    size = F.least(F.col("n"), F.lit(shingle))
    offsets = cut.select("*", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("at"))
    sh = F.lit(None).cast("long")
    for m in range(1, shingle + 1):
        sh = F.when(F.col("size") == m, _shingle(F.col("w"), F.col("at"), m)).otherwise(sh)
    return offsets.select("item_id", "win", "n", "size", "at", sh.alias("sh"))


def shingle_hits(docs: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """``doc_id, text_key, n_words, pos, sh`` of document shingles in ``wanted``, and one marker row per document."""
    split = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"))
    w, n = F.col("w"), F.size("w")
    parts = [F.array(F.struct(F.lit(-1).alias("pos"), _marker().alias("sh")))]
    for m in sizes:
        each = F.transform(F.sequence(F.lit(0), n - m), partial(_placed_shingle, w, m))
        parts.append(F.when(n >= m, each).otherwise(F.array().cast("array<struct<pos:int,sh:bigint>>")))
    rows = split.select(*KEY, n.alias("n_words"), F.explode(F.concat(*parts)).alias("s"))
    return rows.select(*KEY, "n_words", "s.pos", "s.sh").join(small_side(wanted), "sh")


def find_windows(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, text_key, start, n, win``: every occurrence of a window in a document."""
    found = hits.filter("pos >= 0")
    rarity = found.groupBy("sh").agg(F.count(F.lit(1)).alias("freq"))
    shingles = windows.select("win", "n", "size", "at", "sh").dropDuplicates(["win", "at"])
    ranked = shingles.join(rarity, "sh", "left")
    prefix = ranked.groupBy("win", "n", "size").agg(
        F.min_by(F.struct("at", "sh"), F.struct(F.coalesce("freq", F.lit(0)), "at")).alias("p"),
        F.min(F.coalesce("freq", F.lit(0))).alias("least"),
    )
    prefix = cut_lineage(prefix.filter("least > 0").select("win", "n", "size", F.col("p.at").alias("at"), F.col("p.sh").alias("sh")))
    joined = found.join(small_side(prefix, 200_000), "sh")
    start = F.col("pos") - F.col("at")
    placed = joined.select(*KEY, start.alias("start"), "n", "size", "win", "n_words")
    placed = placed.filter("start >= 0 AND start + n <= n_words").drop("n_words").distinct()
    # Shingles at 0, size, 2 * size, ... and the last one cover all words of the window.
    cover = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("n") - F.col("size"), F.col("size")), F.array(F.col("n") - F.col("size"))))
    needed = placed.select("*", F.size(cover).alias("need"), F.explode(cover).alias("at"))
    needed = needed.join(small_side(shingles.select("win", "at", "sh"), 200_000), ["win", "at"])
    needed = needed.withColumn("pos", F.col("start") + F.col("at"))
    there = found.select(*[F.col(k).alias(f"h_{k}") for k in [*KEY, "pos", "sh"]])
    same = (
        F.col("doc_id").eqNullSafe(F.col("h_doc_id"))
        & (F.col("text_key") == F.col("h_text_key"))
        & (F.col("pos") == F.col("h_pos"))
        & (F.col("sh") == F.col("h_sh"))
    )
    verified = needed.join(there, same, "left_semi").groupBy(*KEY, "start", "n", "win", "need").count()
    return verified.filter("count = need").select(*KEY, "start", "n", "win")


def _covered() -> Column:
    """Words in the union of the sorted spans."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("words"))

    def step(acc: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span["end"] - F.greatest(acc["reach"], span["start"]))
        return F.struct(F.greatest(acc["reach"], span["end"]).alias("reach"), (acc["words"] + fresh).alias("words"))

    return F.aggregate(F.array_sort("spans"), zero, step, lambda acc: acc["words"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document row: ``doc_id, text_key, n_words, n_hit, n_items, items`` (sorted ids as strings)."""
    windows = cut_lineage(item_windows(benchmark, window, shingle))
    wanted = windows.select("sh").union(windows.sparkSession.range(1).select(_marker().alias("sh"))).distinct()
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``shingle`` values
    hits = cut_lineage(shingle_hits(docs, cut_lineage(wanted), sizes))
    spans = cut_lineage(find_windows(hits, windows))
    none = lambda kind: F.lit(None).cast(kind)
    span = F.struct("start", (F.col("start") + F.col("n")).alias("end"))
    rows = hits.filter("pos < 0").select(*KEY, "n_words", none("struct<start:int,end:int>").alias("span"), none("string").alias("item"))
    rows = rows.unionByName(spans.select(*KEY, none("int").alias("n_words"), span.alias("span"), none("string").alias("item")))
    owners = windows.select("win", F.col("item_id").cast("string").alias("item")).distinct()
    owned = spans.select(*KEY, "win").distinct().join(owners, "win").select(*KEY, "item").distinct()
    rows = rows.unionByName(
        owned.select(*KEY, none("int").alias("n_words"), none("struct<start:int,end:int>").alias("span"), "item")
    )
    grouped = rows.groupBy(*KEY).agg(
        F.count("n_words").alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set("span").alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    result = grouped.select(
        *KEY, "n_words", _covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "copies"
    )
    return result.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__copy", "copies")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with all their columns."""
    own_id, own_text = free_names(docs, "__id", "__text")
    bad = contamination(docs, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_text)).distinct()
    keep = F.col("doc_id").eqNullSafe(F.col(own_id)) & (text_key(F.col("text")) == F.col(own_text))
    return docs.join(bad, keep, "left_anti")
