"""Language identification and toxicity: held-out accuracy and defined cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from evenlend.llm import language, toxicity

VOCAB = {"aa": "der die und nicht ein haus über".split(), "bb": "the of and house not with over".split(), "cc": "el la casa no sobre y con".split()}


def language_docs():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(VOCAB[lang], k=rng.randrange(4, 30))), lang) for i in range(300) for lang in [rng.choice(sorted(VOCAB))]]
    return rows + [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", None), (None, "the house of", None), (903, "the house of", None), (1, rows[1][1], rows[1][2])]


def test_language_accuracy_and_cases(spark):
    docs = language_docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(1))
    got = language.identify(frame).collect()
    assert len(got) == len(docs)
    truth = {i: lang for i, _, lang in docs}
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] in (None, 903):
            assert r["lang_pred"] == "bb"
        else:
            assert r["lang_pred"] == truth[r["doc_id"]]
    kept = language.keep_identified(frame)
    assert kept.columns == frame.columns and kept.count() == len(docs) - 3
    assert language.identify(frame.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_back_off_and_bounded_cache():
    rows = [("aa", 0, "haus", 4), ("bb", 0, "house", 4), ("aa", 3, "aus", 2), ("bb", 3, "ous", 2), ("aa", 1, "z", 1)]
    model = language.Model.build(rows, 4)
    free = language.Scorer(model)
    assert [free.predict(t)[0] for t in ("haus", "maus", "mouse", "zzz")] == ["aa", "aa", "bb", "aa"]
    tight = language.Scorer(model, cache_rows=3)
    for text in ("maus mouse haus zig zag maus house", "a b c d e f g h", "haus " * 50):
        assert tight.predict(text) == free.predict(text)


def toxic_tables(spark):
    rng = random.Random(9)
    plain = "lorem ipsum dolor sit amet sed do eiusmod tempor magna aliqua".split()
    docs, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = rng.choices(plain, k=rng.randrange(10, 60))
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["grumblefool", "Nastyword", "vilething"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += [(5000, None), (5001, ""), (None, "a grumblefool"), (0, docs[0][1])]
    labels += [(5, None), (5, 1), (7777, 1), (None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity.classify(docs.withColumn("toxic", F.lit("x")).withColumn("score", F.lit(2)), labels.withColumn("text", F.lit("y"))).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(held) > 100
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.97
    assert by[None]["predicted"] == 1
    assert by[5000]["score"] == by[5001]["score"] < 0.3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark)
    few = docs.filter("doc_id < 8")
    assert {r["score"] for r in toxicity.classify(few, labels.limit(0)).collect()} == {0.5}
    assert all(r["score"] < 0.3 for r in toxicity.classify(few, labels.withColumn("toxic", F.lit(0))).collect())
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_buckets_are_those_of_each_ngram():
    text = "Äbc d😀"
    codes = [ord(c) for c in f" {text} ".lower()]
    want = []
    for size in toxicity.SIZES:
        for i in range(len(codes) - size + 1):
            h = codes[i] * 2654435761 % 2**32
            for c in codes[i + 1 : i + size]:
                h = (h * 16777619 % 2**32) ^ (c * 2654435761 % 2**32)
            want.append(((h ^ (h >> 15)) * 2654435761 % 2**32) >> (32 - toxicity.BUCKET_BITS))
    assert toxicity.buckets(text).tolist() == want
