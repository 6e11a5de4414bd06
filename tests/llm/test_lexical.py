"""Ranked lexical search against a plain scorer."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evenlend.llm import lexical


def plain_ranks(docs, items, k):
    split = [(i, lexical.split_terms(t)) for i, t in docs]
    split = [(i, w) for i, w in split if w]
    n, total = len(split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in {(i, t) for i, t in items}:
        wanted = Counter(lexical.split_terms(text))
        scored = []
        for i, w in split:
            tf, m = Counter(w), 75 + (25 * len(w) * n) // total
            score = sum(
                c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t, c in wanted.items()
                if t in tf
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=repr)


ALPHABET = ["alpha", "Beta", "gamma9", "É", "é", "ß", "x-y", "naïve", "T1", "the", "The", "中文", "a_b", "k", "q"]


def test_ranks_equal_a_plain_scorer(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_TILE", 3)
    monkeypatch.setattr(lexical, "DOC_TILE", 7)
    monkeypatch.setattr(lexical, "TERM_TILE", 4)
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choices(ALPHABET, k=rng.randrange(0, 30)))) for i in range(200)]
    docs += [(1000 + i, "alpha beta the") for i in range(60)]  # ties beyond every cut
    docs += [(None, "alpha beta"), (None, None), (300, None), (301, ""), (302, "... --- "), (5, docs[5][1]), (303, "the " * 5000)]
    items = [(i, " ".join(rng.choices(ALPHABET, k=rng.randrange(1, 12)))) for i in range(11)]
    items += [(50, None), (51, ""), (52, "unknownword"), (53, "alpha"), (53, "alpha"), (53, "beta"), (None, "k q"), (54, "the alpha the alpha the")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("n"), "terms": F.lit(0), "score": F.lit(1.0)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(3))
    want = plain_ranks(docs, [(i, t) for i, t in items if t], 6)
    assert rows_of(lexical.rank_documents(frame.repartition(5), asked, 6)) == want
    assert rows_of(lexical.rank_documents(frame, asked, 6, block_chars=60)) == want


def test_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "two one"), (None, "one two")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "ONE")], "item_id string, text string")
    none = lexical.rank_documents(docs.limit(0), items)
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0
    found = lexical.rank_documents(docs.union(docs.limit(0)), items, 2).orderBy("rank").collect()
    # Every document holds the term, so its weight is floor(1000 ln(8/7)).
    assert [r["doc_id"] for r in found] == ["a", "b"] and found[0]["score"] == found[1]["score"] > 0


def test_batches_split_as_items_do():
    rng = random.Random(3)
    letters = "aZé9ÀßİK_-.,\x00\x7f \n|中😀"
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 40))) for _ in range(300)] + [None, ""]
    known = sorted({t for x in texts for t in lexical.split_terms(x)})
    total, row, term, count = lexical.count_batch(pa.array(texts), pa.array(known))
    got = [Counter() for _ in texts]
    for r, t, c in zip(row, term, count):
        got[r][known[t]] = c
    assert got == [Counter(lexical.split_terms(x)) for x in texts]
    assert total.tolist() == [len(lexical.split_terms(x)) for x in texts]


def test_partial_sums_stay_exact():
    """Items of a repeated heavy term are cut into slices under the bound; their sum is the exact 64-bit score."""
    room = (lexical.EXACT - 1) // lexical.MOST_IMPACT
    counts = [Counter({0: 3 * room // 20_000, 1: 5}), Counter({1: 1})]
    (first, slices), = lexical.item_tiles(counts, np.array([20_000, 7]))
    assert first == 0 and len(slices) > 1
    assert all((s.weights.sum(axis=1) * lexical.MOST_IMPACT < lexical.EXACT).all() for s in slices)
    row, term, impact = np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([999_999, 123_457, 999_998])
    got = lexical.tile_scores(slices, 2, 2, row, term, impact)
    heavy = counts[0][0] * 20_000
    assert got.tolist() == [[heavy * 999_999 + 35 * 123_457, 35 * 999_998], [7 * 123_457, 7 * 999_998]]


def test_long_lengths_do_not_overflow():
    corpus = lexical.Corpus(10**10, 10**13)
    n = np.array([1, 10**9, 10**8])
    assert corpus.middle(n).tolist() == [75 + 25 * int(x) * 10**10 // 10**13 for x in n]
