"""Packing, sharding, exact search and revisit resolution against plain versions."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenlend.llm import packing, sharding, topk, warc


def test_first_fit_decreasing_matches_a_scan_over_bins():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room, want = [], {}
        for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
            b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            room += [100] * (b == len(room))
            want[i] = (b, 100 - room[b])
            room[b] -= int(lengths[i])
        assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(n)]


TEXTS = [
    None, "", " ", "\n\n", "Hello, world. It's fine", "ÄÖÜ straße, çà et là.", "é combining", "ﬁ ligature Ⅷ ² 10,000.50", "İstanbul ΣΑΣ ς",
    "tab\there nbsp em\x0b\x1cfs", "don't we'll he'd I'M", "😀 emoji👍🏽 中文 字符 עברית", "a" * 3000, "x.,y ,. .", "<|endoftext|> in text <|startoftext|>", "word " * 9000, "\r\nwin\r\n",
]


def test_identifiers_of_a_batch_take_little_more_room_than_themselves():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    plain, ours = Tokenizer.from_file(path), packing.PartEncoder(path)
    texts = ["of the 7 words, " * 20_000, "", None, "x<|endoftext|>y", "the end\n" * 30_000]
    batch = pa.array(texts, pa.string())
    tracemalloc.start()
    ids, _ = ours.encode_batch(pa.array(["of the 7 words, " * 300_000], pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(ids), peak / len(ids)  # offsets of all identifiers at once took over 30 bytes each
    ids, counts = ours.encode_batch(batch)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    ours.forget()
    assert not ours.young and not ours.old


def test_tokens_equal_those_of_whole_texts():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    plain, ours = Tokenizer.from_file(path), packing.PartEncoder(path, cache_parts=8)
    rng = random.Random(8)
    letters = "abzäÉßñ'.,;:-!?0189 \n\tẤ한"
    for text in [t for t in TEXTS if t] + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(400)]:
        got = np.frombuffer(ours.encode(text), "<u4").tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids, text


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3]), (3, TEXTS[3])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("l")).withColumn("place", F.lit(0))
    got = packing.pack(frame, group_rows=5).toPandas()
    ids = {i: [*(plain.encode(t, add_special_tokens=False).ids if t else []), packing.END_ID] for i, t in docs}
    copies = {i: sum(j == i for j, _ in docs) for i in ids}
    for i, own in ids.items():
        rows = got[got["doc_id"].isna() if i is None else got["doc_id"] == i]
        starts = list(range(0, len(own), packing.CAPACITY))
        assert sorted(rows["start"]) == sorted(starts * copies[i])
        for s, n, crc, total in rows[["start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False):
            assert total == len(own)
            assert crc == zlib.crc32(np.array(own[s : s + n], "<u4").tobytes())
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert list(seq["offset"]) == [0, *np.cumsum(seq["length"])[:-1]]
        assert seq["length"].sum() <= packing.CAPACITY
    assert packing.pack(frame.limit(0)).count() == 0
    kept = packing.token_pieces(frame, keep_ids=True).toPandas()
    assert all(zlib.crc32(b) == c for b, c in zip(kept["ids"], kept["ids_crc32"]))


def test_sharding(spark):
    docs = [(i, "same text" if i % 3 == 0 else f"text ü {i}") for i in range(2000)] + [(None, None), (None, "n"), (4, "again"), (4, "again"), (-1, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("s")).withColumn("slot", F.lit(1))
    tree = sharding.even_tree(16)
    got = sharding.assign(frame, tree, sharding.grow(tree)).toPandas()
    assert len(got) == len(docs)
    assert sorted(zip(got["size"], got["text_crc32"])) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in docs)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    counts = got["shard"].value_counts()
    assert set(counts.index) == set(range(16)) and counts.min() > 80 and counts.max() < 180
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and 60 < len(moved) < 190
    assert got[got["doc_id"] == 4]["shard"].nunique() == 1
    assert sharding.assign(frame.limit(0), tree).count() == 0


def test_weight_changes_move_rows_only_along_their_path(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.even_tree(16)
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else s.weight) for s in tree]
    path = {s.shard: (s.region, s.rack) for s in tree}
    before, after = sharding.place(keys, tree), sharding.place(keys, heavier, out="later")
    rows = before.join(after, "doc_id").filter("shard <> later").collect()
    assert rows
    for r in rows:
        old, new = path[r["shard"]], path[r["later"]]
        # Nothing enters a region, a rack of it or a shard of that but the one whose weight grew.
        assert new[0] == path[5][0]
        if old[0] == new[0]:
            assert new == path[5]
        if old == new:
            assert r["later"] == 5
    with pytest.raises(ValueError):
        sharding.place(keys, [sharding.Shard("r", "k", 0, 0.0)])


def test_slots_of_a_hot_id(spark):
    frame = spark.createDataFrame([(1, f"{i % 2}") for i in range(500)], "doc_id long, text string").repartition(6)
    got = sharding.assign(frame, sharding.even_tree(4)).toPandas()
    assert sorted(got["slot"]) == list(range(500))


def plain_top(rows, k):
    q = {i: v for i, v in rows if i % 10 == 0}
    out = []
    for i, v in sorted(q.items()):
        scores = sorted({(-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i})
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return out


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8)) * 3
    vectors = [(i, [float(x) for x in centres[i % 6] + 0.3 * rng.normal(size=8)]) for i in range(300)]
    vectors += [(300 + i, [0.5] * 8) for i in range(80)] + [(400, [0.0] * 8), (410, [9.0] * 8), (420, [0.25] * 5)]
    odd = [(500, None), (510, [1.0, None] + [0.0] * 6), (520, [float("nan")] * 8), (530, [float("inf")] * 8), (None, [1.0] * 8), vectors[0], vectors[10]]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("s")).withColumn("v", F.lit(1))
    exact = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors]
    monkeypatch.setattr(topk, "CELL_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 20)
    monkeypatch.setattr(topk, "PROBE", 40)
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0, 10).collect()
    assert sorted(map(tuple, got)) == plain_top(exact, 10)


def test_top_k_copies_cells_to_the_blocks_that_ask(spark, monkeypatch):
    """Twice the blocks do not copy the index once more: rows are held per (cell, block) that some query reaches."""
    monkeypatch.setattr(topk, "CELL_ROWS", 16)
    index = spark.createDataFrame([(i, i % 5, i % 3, (i // 15) % 2, 2) for i in range(600)], "vec_id long, pivot int, ring int, part int, parts int")
    reach = spark.createDataFrame([(q, q % 5, 0) for q in range(40)] + [(40, 9, 9)], "place long, pivot int, ring int")
    for blocks in (1, 4, 16):
        asked = topk.asked_cells(reach, index, blocks)
        assert asked.count() == 40 * 2  # both parts of every cell that exists
        pairs = {(r["pivot"], r["block"]) for r in asked.collect()}
        assert topk.held_cells(index, asked).count() == len(pairs) * 40
    assert [topk.pivot_count(n) for n in (0, 900, 10**4, 10**8)] == [32, 32, 100, 10**4]


def test_top_k_of_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, 3).collect()
    unit = 1024 * 1024
    assert sorted(map(tuple, got)) == [(0, 1, 2, 3 * unit), (0, 2, 1, 2 * unit), (0, 3, 1, unit)]


def test_top_k_of_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0, 10).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 3 * 1024 * 1024), (0, 2, 2, 3 * 1024 * 1024)]
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def plain_resolve(records):
    """Every revisit against every response."""
    out = {}
    for r in records:
        if r["status"] != 304:
            continue
        key = canonical(r["url"])
        earlier = [
            o
            for o in records
            if o["status"] == 200 and key is not None and canonical(o["url"]) == key and None not in (o["captured_at"], r["captured_at"]) and o["captured_at"] < r["captured_at"]
        ]
        if not earlier:
            out[r["record_id"]] = ("no_response", None)
            continue
        seen = max(earlier, key=lambda o: (o["captured_at"], o["record_id"]))
        mine, theirs = ({k.lower(): v for k, v in (x["headers"] or {}).items()} for x in (r, seen))
        same = False
        if "etag" in mine:
            same = mine["etag"].removeprefix("W/") == theirs.get("etag", "?").removeprefix("W/")
        elif "last-modified" in mine:
            same = mine["last-modified"] == theirs.get("last-modified")
        elif r["digest"] is not None:
            same = r["digest"] == seen["digest"]
        out[r["record_id"]] = ("resolved", seen["record_id"]) if same else ("mismatch", None)
    return out


def canonical(url):
    return {None: None, "": None}.get(url, (url or "").lower().replace("www.", "").replace(":80/", "/").split("#")[0].split("://")[-1].rstrip("/"))


def capture_records():
    rng = random.Random(3)
    records = []
    for i in range(400):
        url = rng.choice(["http://www.A.org/x/", "https://a.org:80/x", "http://a.org/x#f", f"http://b.org/{i % 7}", None, ""]) if i % 3 else "http://hot.org/p"
        tag = rng.choice(['"1"', '"2"', 'W/"1"', None])
        headers = {"ETag": tag, "Last-Modified": rng.choice(["d1", "d2", None])}
        headers = None if i % 50 == 7 else {k: v for k, v in headers.items() if v}
        records.append(
            {"record_id": i, "url": url, "captured_at": None if i % 31 == 0 else rng.randrange(60), "status": rng.choice([200, 304, 304, 500]), "digest": rng.choice(["x", "y", None]), "headers": headers}
        )
    return records


def test_revisits_match_brute_force(spark):
    records = capture_records()
    schema = "record_id long, url string, captured_at long, status int, digest string, headers map<string,string>"
    frame = spark.createDataFrame([tuple(r.values()) for r in records], schema).withColumn("seen", F.lit(1)).withColumn("canonical_url", F.lit("c"))
    got = {r["record_id"]: (r["outcome"], r["response_id"]) for r in warc.resolve(frame.repartition(5)).collect()}
    assert got == plain_resolve(records)
    assert {o for o, _ in got.values()} == {"resolved", "mismatch", "no_response"}
    assert warc.resolve(frame.limit(0)).count() == 0


def test_permitted_headers_are_merged(spark):
    schema = "record_id long, url string, captured_at long, status int, digest string, headers map<string,string>, body string"
    rows = [
        (1, "http://a.org/", 1, 200, "x", {"ETag": '"1"', "Content-Length": "9", "Date": "d1", "X-A": "k"}, "payload"),
        (2, "http://www.a.org", 2, 304, None, {"etag": 'W/"1"', "content-length": "0", "DATE": "d2", "x-a": "n"}, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    found = warc.resolve(frame)
    row = found.first()
    assert (row["outcome"], row["response_id"], row["matched_by"]) == ("resolved", 1, "etag")
    assert row["headers"] == {"etag": 'W/"1"', "content-length": "9", "date": "d2", "x-a": "k"}
    assert warc.payloads(found, frame, "body").first()["body"] == "payload"


def test_canonical_urls(spark):
    cases = {
        "HTTP://www.Example.org:80/a/?b=2&a=1&utm_source=x#f": "example.org/a?a=1&b=2",
        "https://u:p@Example.org:8443": "example.org:8443",
        "  http://e.org/%20 ": "e.org/%20",
        "not a url": "not a url",
        "": None,
        None: None,
        "http://e.org/a?gclid=1": "e.org/a",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == cases
