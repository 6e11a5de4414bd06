"""Near copies by exact shingle similarity, the near-duplicate stage of the pipeline.

Two texts are near copies if the sets of their ``WORDS``-word shingles have a Jaccard similarity of ``LEAST`` or more;
groups are connected by such pairs.

1. A text gets a SimHash of its distinct shingles. The hierarchical index of ``simhash`` (masked fields, runs in Gray order, differences
   added up down the tree) gives pairs of fingerprints of at most ``MAX_BITS`` differing bits, which connect all such pairs; texts of one
   fingerprint hang on the smallest of them. These are the first candidates.
2. At similarity 0.8 about 10 of 64 bits differ, so that index alone would lose pairs. For those a text also gets ``BANDS * ROWS`` minimum hashes
   of its shingles. Texts that agree in a whole band of ``ROWS`` are candidates too; a pair of similarity J is missed by the bands with
   probability ``(1 - J ** ROWS) ** BANDS``: 5e-5 at 0.8, 8e-7 at 0.85.
3. The sorted shingle hashes of texts with a candidate are written once; texts do not move any more.
4. The pairs of the index, and of each text the pair with the smallest text it shares a band with, are compared by their exact shingle sets. Where
   many texts have the same partner, they are dealt into units of ``BLOCK`` by a hash, each with that text's hashes. What is near forms first groups.
5. A band whose members are all of one group needs nothing more. In the others (once, where bands have the same members) all pairs
   of different groups are compared. A band of more than ``BLOCK`` texts is dealt into blocks by a hash, and pairs of blocks are
   separate units of work, each of which writes a spanning forest of its near copies. So only texts that share a band are ever compared:
   no closure over bands joins what merely shares boilerplate.

Words, shingles and hashes are those of ``simhash`` (with ``WORDS`` words). Defined cases: null and empty texts, and texts of
white space, have one common shingle and are copies of each other only; a text of fewer words than a shingle is one shingle;
null ids take part but are not the smallest id while another exists; repeated rows give one row; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, free_names, release_buffers, small_side, text_key
from .components import components
from .simhash import fingerprint_links, majority

WORDS = 5
LEAST = 0.8
MAX_BITS = 6
BANDS = 25
ROWS = 5
BLOCK = 256
SEED = 42
_MIX = np.random.RandomState(SEED).randint(0, 1 << 64, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
_FLIP, _ODD = _MIX[0], _MIX[1] | np.uint64(1)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order; never empty."""
    found = (text or "").encode().lower().split()
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], dtype=np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key per band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):  # bounded memory for very long texts
        np.minimum(least, ((hashes[at : at + 512] ^ _FLIP) * _ODD).min(axis=1), out=least)
    raw = least.astype("<u8").tobytes()
    step = ROWS * 8
    return [xxhash.xxh64_intdigest(raw[b * step : (b + 1) * step], b) for b in range(BANDS)]


def marked_texts(keyed: DataFrame) -> DataFrame:
    """``key, fp, bands``: the SimHash (64 bits as a signed long) and the band keys of every distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            fps = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            found = np.array([bands(s) for s in sets], dtype=np.uint64).reshape(-1).view(np.int64)
            places = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.ListArray.from_arrays(places, pa.array(found))], ["key", "fp", "bands"])
            release_buffers()

    marked = keyed.select("key", "text").mapInArrow(run, "key bigint, fp bigint, bands array<bigint>")
    return marked.dropDuplicates(["key"])


def index_pairs(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``first, key``: pairs of texts of ``key, fp`` that the SimHash index links, enough to connect all it links."""
    heads = cut_lineage(prints.groupBy("fp").agg(F.min("key").alias("head")))
    links = fingerprint_links(heads.select("fp"), max_bits, direct=True)
    one, two = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    between = links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("first"), F.greatest("x", "y").alias("key"))
    same = prints.join(heads, "fp").filter("key <> head").select(F.col("head").alias("first"), "key")
    return between.unionByName(same)


def unit_links(sets: list[np.ndarray], side: np.ndarray, within: bool, least: float = LEAST, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions of near copies that connect all near copies of a unit; ``within`` allows pairs of one side.

    Texts of equal ``known`` are connected already.
    """
    count, sizes = len(sets), np.array([len(s) for s in sets])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(count, dtype=np.int32), sizes)
    order = np.argsort(hashes, kind="stable")
    owner, first = owner[order], np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
    many = np.diff(np.append(first, len(hashes)))
    place = np.empty(len(hashes), dtype=np.int64)
    place[order] = np.repeat(np.arange(len(first)), many)
    ends = np.cumsum(sizes)
    label = np.arange(count) if known is None else np.unique(known, return_inverse=True)[1]
    out = []
    for i in range(count - 1):
        open_ = label[i + 1 :] != label[i]
        if not within:
            open_ &= side[i + 1 :] != side[i]
        if not open_.any():
            continue
        mine = place[ends[i] - sizes[i] : ends[i]]
        mine = mine[many[mine] > 1]
        if not len(mine):
            continue
        n = many[mine]
        at = np.arange(n.sum()) + np.repeat(first[mine] - np.append(0, np.cumsum(n)[:-1]), n)
        common = np.bincount(owner[at], minlength=count)[i + 1 :]
        near = open_ & (common / (sizes[i] + sizes[i + 1 :] - common) >= least)
        for j in (i + 1 + np.flatnonzero(near)).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _hashes(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy().view(np.uint64)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``key, hashes``: the sorted shingle hashes of every text, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["key", "hashes"])
            release_buffers()

    return texts.select("key", "text").mapInArrow(run, "key bigint, hashes array<bigint>").groupBy("key").agg(F.first("hashes").alias("hashes"))


def star_links(tried: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """``a, b``: the pairs ``first, key`` of ``tried`` that are near copies; every pair is there once."""
    sizes = tried.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    many = cut_lineage(sizes.filter("parts > 1"))
    dealt = tried.join(small_side(many), "first", "left").fillna(1, ["parts"])
    dealt = cut_lineage(dealt.select("first", "key", F.pmod(F.xxhash64("key", F.lit("part")), F.col("parts")).cast("int").alias("part")))
    heads = dealt.select(F.col("first").alias("key"), "part").distinct().join(sets, "key")
    heads = heads.select(F.col("key").alias("first"), "part", F.lit(0).alias("member"), "key", "hashes")
    members = dealt.join(sets, "key").select("first", "part", F.lit(1).alias("member"), "key", "hashes")
    rows = heads.unionByName(members).repartition("first", "part").sortWithinPartitions("first", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)  # a unit may go on in the next batch
        for batch in batches:
            found = []
            for i, (first, member, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                mine = _hashes(batch.column(4), i)
                if not member:
                    head = mine.copy()
                    continue
                common = len(np.intersect1d(head, mine, assume_unique=True))
                if common / (len(head) + len(mine) - common) >= LEAST:
                    found.append((first, key))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
            release_buffers()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _verified(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """``a, b``: links between texts of different ``label`` within each ``band`` of ``band, key, label``."""
    counts = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large = cut_lineage(counts.select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = members.join(small_side(large), "band", "left").fillna(1, ["blocks"])
    own = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int")
    dealt = dealt.select("key", "band", "label", "blocks", own.alias("own"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    unit = dealt.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "key", "label")
    # A pair of blocks whose texts are all of one group has nothing to find, and its hashes are not moved.
    mixed = unit.groupBy("band", "lo", "hi").agg(F.min("label").alias("one"), F.max("label").alias("two")).filter("one <> two")
    unit = unit.join(cut_lineage(mixed.select("band", "lo", "hi")), ["band", "lo", "hi"], "left_semi").join(sets, "key")
    units = unit.select("band", "lo", "hi", "side", "key", "label", "hashes").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, found = None, [], []  # a unit may go on in the next batch

        def solve() -> pa.RecordBatch:
            side, keys, labels = (np.array(x) for x in zip(*rows))
            links = unit_links(found, side, held[1] == held[2], known=labels) if len(found) > 1 else []
            pairs = [pa.array([keys[p[k]] for p in links], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(pairs, ["a", "b"])

        for batch in batches:
            for i, (band, lo, hi, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if (band, lo, hi) != held:
                    if held is not None:
                        yield solve()
                    held, rows, found = (band, lo, hi), [], []
                rows.append(row), found.append(_hashes(batch.column(6), i).copy())
            release_buffers()
        if held is not None:
            yield solve()

    return units.mapInArrow(run, "a bigint, b bigint")


def open_bands(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``band, key, label`` of the bands whose members are of several groups, once for bands of equal members."""
    named = groups.select(F.col("node").alias("key"), F.col("component").alias("label"))
    labelled = cut_lineage(members.select("band", "key").join(named, "key", "left").select("band", "key", F.coalesce("label", "key").alias("label")))
    mark = F.xxhash64("key")
    bands = labelled.groupBy("band").agg(
        F.min("label").alias("one"), F.max("label").alias("two"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least_key"),
        F.bit_xor(mark).alias("mark"), F.sum(F.xxhash64("key", F.lit(SEED)).cast("decimal(38,0)")).alias("total"),
    )
    bands = bands.filter("one <> two").groupBy("n", "least_key", "mark", "total").agg(F.min("band").alias("band"))
    return labelled.join(small_side(cut_lineage(bands.select("band"))), "band", "left_semi")


def near_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``key, least, component``: every distinct text, its smallest document id and the group of near copies it is in."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    ids = cut_lineage(keyed.groupBy("key").agg(F.min("doc_id").alias("least")))
    marked = cut_lineage(marked_texts(keyed))
    linked = cut_lineage(index_pairs(marked.select("key", "fp")))
    placed = marked.select(F.explode("bands").alias("band"), "key")
    shared = placed.groupBy("band").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(placed.join(small_side(cut_lineage(shared.select("band", "first"))), "band").select("band", "first", "key"))
    paired = members.select("key").union(linked.select("key")).union(linked.select("first")).distinct()
    wanted = cut_lineage(paired.join(ids, "key"))
    named = small_side(wanted.select(F.col("key").alias("k"), "least"))
    texts = keyed.join(named, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("key", "text")
    sets = cut_lineage(shingle_sets(texts))
    starred = members.groupBy("key").agg(F.min("first").alias("first")).filter("first <> key")
    tried = linked.unionByName(starred.select("first", "key")).distinct()
    near = cut_lineage(star_links(cut_lineage(tried), sets, block))
    rest = _verified(cut_lineage(open_bands(members, components(near, "a", "b"))), sets, block)
    groups = components(near.unionByName(rest), "a", "b").select(F.col("node").alias("key"), "component")
    return ids.join(groups, "key", "left").select("key", "least", F.coalesce("component", "key").alias("component"))


def drop_near_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Of repeated ids within a group the smallest text hash stays, of fully repeated rows one.
    """
    pick = F.struct(F.col("least").isNull().alias("z"), F.col("least"), F.col("key"))
    stays = near_copies(docs, block).groupBy("component").agg(F.min(pick).alias("p"))
    own_id, own_text, key = free_names(docs, "__id", "__text", "__key")
    stays = stays.select(F.col("p.least").alias(own_id), F.col("p.key").alias(own_text))
    keyed = docs.withColumn(key, text_key(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_text))
    return keyed.join(stays, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
