"""Operator 5: packing by first-fit decreasing with a tournament tree, in randomised groups.

Documents are tokenized where they lie. One of more than ``capacity`` tokens is cut into full pieces and a rest, so every
piece is known, with its checksum, before anything is placed; only narrow rows (id, start, length, checksum) move. Full
pieces are sequences by themselves. The other pieces are dealt by a hash of their place in the written piece table into
groups of about ``GROUP_ROWS``, so neither a hot source nor equal documents share a group. Each group is packed alone:
pieces by decreasing length, each into the first bin with room, found by descending a tournament tree of the bins' free
space. What a group's last bins leave free is at most about a sequence per group.

Tokens: identifiers of a public word-end byte-pair vocabulary, then the end identifier. White space never joins two
tokens, so a text's identifiers are those of its space- and newline-separated parts in order; the distinct parts of a batch are
looked up in a bounded cache, only unseen ones are encoded, and the batch's identifiers are gathered by offsets.

Defined cases: null and empty texts are one piece with the end identifier only; null and repeated ids stay, each row
with its own pieces; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, release_buffers

CAPACITY = 4096
GROUP_ROWS = 4096
END_ID = 2
CACHE_PARTS = 600_000
BATCH_BYTES = 8 << 20  # of texts whose parts are looked up together
RUN_PARTS = 1 << 16  # parts that are looked up, or gathered, at once within a batch
SEED = 5
SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PartEncoder:
    """Identifiers of texts, as little-endian 32-bit bytes, through a two-generation cache of their parts."""

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.marks = [b"", self._whole("."), self._whole(",")]
        self.limit = cache_parts // 2
        self.forget()

    def forget(self) -> None:
        """Empties the cache."""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, part: str) -> bytes:
        return _packed(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _word(self, letters: str) -> bytes:
        """A run of lower-case Latin letters goes straight to the merge table: it is already normalised and one pre-token."""
        found = self.young.get(letters)
        if found is None:
            found = self.old.get(letters)
            if found is None:
                symbols = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
                found = _packed([t.id for t in self.tokenizer.model.tokenize(symbols)])
            self._keep(letters, found)
        return found

    def _keep(self, part: str, found: bytes) -> None:
        if len(part) <= 64:
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[part] = found

    def _other(self, part: str) -> bytes:
        found = self.young.get(part)
        if found is None:
            found = self.old.get(part)
            if found is None:
                found = self._whole(part)
            self._keep(part, found)
        return found

    def _parts(self, parts: pa.Array) -> list[bytes]:
        """Identifiers of distinct parts. Spellings of a word with a capital or a closing mark share the word's."""
        simple = pc.match_substring_regex(parts, SIMPLE)
        plain = parts.filter(simple)
        words = pc.utf8_lower(pc.utf8_rtrim(plain, ".,")).dictionary_encode()
        found = [self._word(w) for w in words.dictionary.to_pylist()]
        marks = pc.add(pc.cast(pc.ends_with(plain, "."), pa.int8()), pc.multiply(pc.cast(pc.ends_with(plain, ","), pa.int8()), 2)).to_pylist()
        spelt = iter([found[w] + self.marks[m] if m else found[w] for w, m in zip(words.indices.to_pylist(), marks)])
        others = iter([self._other(p) for p in parts.filter(pc.invert(simple)).to_pylist()])
        return [next(spelt if s else others) for s in simple.to_pylist()]

    def encode(self, text: str) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0].tobytes()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts, one after another, and how many each text has. Null texts have none.

        Only the distinct parts of the batch are looked up; their identifiers are then gathered by offsets, some parts at a time, as the
        offsets take several times the room of the identifiers.
        """
        texts = pc.fill_null(texts, "")
        # May hold the name of a special token, which is matched before anything is split.
        special = pc.match_substring(texts, "<|")
        split = pc.split_pattern(pc.replace_substring(pc.if_else(special, "", texts), "\n", " "), " ")
        coded = pc.list_flatten(split).dictionary_encode()
        firsts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()  # every row has a part
        del split
        part = coded.indices.to_numpy(zero_copy_only=False)
        size, pool = self._pool(coded.dictionary)
        heads = np.cumsum(size, dtype=np.int32) - size
        ids = np.concatenate([np.zeros(0, "<u4"), *(_gathered(pool, heads, size, part[i : i + RUN_PARTS]) for i in range(0, len(part), RUN_PARTS))])
        counts = np.add.reduceat(size[part], firsts, dtype=np.int64) if len(firsts) else np.zeros(0, np.int64)
        if special.true_count:
            rows = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
                rows[i] = np.frombuffer(self._whole(texts[i].as_py()), "<u4")
            ids, counts = np.concatenate(rows), np.array([len(r) for r in rows])
        return ids, counts

    def _pool(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many identifiers each of the distinct parts has, and all of them."""
        sizes, pools = [np.zeros(0, np.int32)], []
        for i in range(0, len(parts), RUN_PARTS):
            known = self._parts(parts.slice(i, RUN_PARTS))
            sizes.append(np.fromiter(map(len, known), np.int32, len(known)) // 4)
            pools.append(b"".join(known))
        return np.concatenate(sizes), np.frombuffer(b"".join(pools), "<u4")


def _gathered(pool: np.ndarray, heads: np.ndarray, size: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Identifiers of ``part``, one after another; a part's lie in ``pool`` from its head."""
    each = size[part]
    ends = np.cumsum(each, dtype=np.int64)
    return pool[np.repeat(heads[part] - (ends - each), each) + np.arange(ends[-1])]


_ENCODERS: dict[str, PartEncoder] = {}  # a worker keeps its tokenizer from task to task; the cache goes with its task, as other work follows


def _encoder(path: str) -> PartEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``BATCH_BYTES`` together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece, and with ``keep_ids`` the identifiers as binary."""
    place = path or vocabulary_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(place)
        try:
            for batch in batches:
                first = 0
                for texts in _slices(batch.column(1)):
                    ids, counts = encoder.encode_batch(texts)
                    total = counts + 1
                    whole = np.insert(ids, np.cumsum(counts), END_ID)
                    del ids
                    pieces = -(-total // capacity)
                    row = np.repeat(np.arange(len(counts)), pieces)
                    start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                    length = np.minimum(capacity, total[row] - start)
                    at = (np.cumsum(total) - total)[row] + start
                    view = memoryview(whole).cast("B")
                    crc = [zlib.crc32(view[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), length.tolist())]
                    columns = [batch.column(0).take(pa.array(row + first)), *[pa.array(x, pa.int64()) for x in (start, length, crc, total[row])]]
                    kept = [pa.array([view[4 * i : 4 * (i + n)].tobytes() for i, n in zip(at.tolist(), length.tolist())], pa.binary())] if keep_ids else []
                    first += len(texts)
                    yield pa.RecordBatch.from_arrays([*columns, *kept], names)
                release_buffers()
        finally:
            encoder.forget()
            release_buffers()

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if keep_ids else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class BinTree:
    """Tournament tree over the free space of bins; the leftmost bin with room is found in logarithmic time."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first bin with room: the bin and its free space before."""
        at, room = 1, self.room
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        before = room[at]
        room[at] -= size
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return leaf, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; equal lengths keep their order."""
    tree = BinTree(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], before = tree.take(int(lengths[i]))
        offsets[i] = capacity - before
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    pieces = cut_lineage(token_pieces(docs, path, capacity)).withColumn("place", F.monotonically_increasing_id())
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("bunch", F.pmod(F.xxhash64("place", F.lit(SEED)), F.lit(groups)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", ignore_index=True)
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), capacity)
        part["sequence_id"], part["offset"] = part["bunch"] * (1 << 32) + bins, offsets
        return part.drop(columns=["place", "bunch"])

    kind = dict(pieces.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("bunch").applyInPandas(run, schema)
