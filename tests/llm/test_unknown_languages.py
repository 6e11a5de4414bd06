"""Texts of unlearned languages and scripts leave the corpus, clean documents stay."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenlend.llm import language

SMALL = "/root/testdata/sf0.001"
FOREIGN = [
    "Мороз и солнце день чудесный ещё ты дремлешь друг прелестный",
    "人人生而自由在尊严和权利上一律平等 他们赋有理性和良心",
    "Πάντες άνθρωποι του ειδέναι ορέγονται φύσει",
    "bqkd xwpo zzrvt kmf uyqgh plxw qjso wvbn trkz ghqa",
    "Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił",
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita",
    "12 34 !!",
]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="tables not present")
def test_unlearned_languages_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(10_000 + i, t) for i, t in enumerate(FOREIGN)]
    foreign = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.unionByName(foreign.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"])), allowMissingColumns=True)
    got = {r["doc_id"] for r in corpus_pipeline.identify(spark, both, SMALL).select("doc_id").collect()}
    lettered = {r["doc_id"] for r in docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert got == lettered


def test_evidence_and_bounded_cache():
    rows = [("aa", 0, "haus", 4), ("bb", 0, "house", 4), ("aa", 4, " hau", 2), ("aa", 4, "haus", 2), ("bb", 4, "ouse", 2), ("aa", 1, " ", 9)]
    model = language.Model.build(rows, 4)
    free = language.Judge(model, model.known_words())
    assert [free.judge(t)[2] for t in ("haus", "hauser", "zz", "дом")] == [1.0, 0.4, 0.0, 0.0]
    tight = language.Judge(model, model.known_words(), cache_rows=3)
    for text in ("hauser mouse haus zig zag hauser house", "a b c d e f g h", "haus " * 50):
        assert tight.judge(text) == free.judge(text)
        assert free.judge(text)[:2] == free.predict(text)


def test_model_travels_compressed():
    rows = [("aa" if i % 2 else "bb", 0, f"{i:x}haus", 1 + i % 7) for i in range(20_000)]
    model = language.Model.build(rows, 4)
    packed = model.packed(True)
    again, known = language.Model.unpacked(packed)
    assert (again.langs, again.words, again.grams, again.longest, again.penalty) == (model.langs, model.words, model.grams, model.longest, model.penalty)
    assert (again.costs == model.costs).all() and (known == model.known_words()).all()
    assert len(packed) < (model.costs.nbytes + known.nbytes) / 4
