"""Benchmark decontamination and license scans against plain versions."""

import random
import re

from pyspark.sql import functions as F

from evenlend.llm import decontaminate, licenses
from evenlend.llm.common import WORD

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def plain_hits(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, owners = set(), set()
        for item_id, item in items:
            v = plain_words(item)
            n = min(len(v), window)
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    owners.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(owners)))
    return sorted(out, key=repr)


def found_hits(docs, items):
    rows = decontaminate.contamination(docs, items).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows], key=repr)


def test_windows_match_brute_force(spark):
    rng = random.Random(3)
    vocab = "a b c d é Z9 straße the of".split()
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 4, 5, 7, 10, 13, 25])))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for i in range(60):
        w = rng.choices(vocab, k=rng.randrange(60))
        if i % 3 == 0:
            w[10:10] = plain_words(rng.choice(items)[1])
        docs.append((i, rng.choice([" ", "\n", "--"]).join(w)))
    docs += [(100, None), (101, ""), (None, items[5][1]), (None, None), (7, docs[7][1]), (0, docs[0][1]), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sh", F.lit(1)).withColumn("win", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("size", F.lit(1))
    assert found_hits(d, b) == plain_hits(docs, items)
    dirty = {(i, n) for i, n, hit, _ in plain_hits(docs, items) if hit}
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(kept.select("doc_id", "text").collect(), key=repr) == sorted(
        [r for r in d.select("doc_id", "text").collect() if (r["doc_id"], len(plain_words(r["text"]))) not in dirty], key=repr
    )


def test_windows_without_broadcast(spark, monkeypatch):
    docs = [(i, "x y " * i + "one two three four five six seven eight nine ten eleven") for i in range(20)]
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "x y x")]
    monkeypatch.setattr(decontaminate, "small_side", lambda df, rows=0: df)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found_hits(d, b) == plain_hits(docs, items)


def test_windows_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert found_hits(docs, items.limit(0)) == [(1, 2, 0, [])]
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == 1


def plain_scan(text, templates, base, threshold):
    """Every block against every template, without an index."""
    w = plain_words(text)
    labels, places, score = set(), set(), 0.0
    sets = [set(plain_words(t.text)) for t in templates]
    sizes = [next(b for b in (128, 256, 512, 1024, 2048) if b >= 2 * len(plain_words(t.text))) for t in templates]
    for block in set(sizes):
        half = block // 2
        for s in range(0, max(1, len(w) - half), half) if len(w) > block else [0]:
            part = w[s : s + block]
            found = {}
            for k, t in enumerate(templates):
                if sizes[k] != block:
                    continue
                v = plain_words(t.text)
                share = len(sets[k] & set(part)) / len(sets[k])
                if t.phrase:
                    at = [i for i in range(len(part) - len(v) + 1) if part[i : i + len(v)] == v]
                    if not at:
                        continue
                    if k < base:
                        places |= {(s + i, t.label) for i in at}
                elif share < threshold - 1e-9:
                    continue
                found[k] = share
            for k, share in found.items():
                inner = any(sets[k] < sets[j] and sets[j] - sets[k] <= set(part) for j in found if not templates[j].phrase)
                outer = any(sets[j] < sets[k] and not sets[k] - sets[j] <= set(part) for j in found if not templates[j].phrase)
                if templates[k].phrase or not (inner or outer):
                    labels.add(templates[k].label)
                    score = max(score, share)
    return len(w), sorted(places), sorted(labels), score


def test_license_scan_matches_all_against_all(spark):
    rng = random.Random(5)
    templates = [*licenses.BASE, *licenses.NOTICES]
    filler = "the of and to in a copy license software this free mit under version cc by".split()
    docs = []
    for i in range(80):
        w = rng.choices(filler, k=rng.randrange(0, 400))
        for _ in range(rng.randrange(3)):
            v = plain_words(rng.choice(templates).text)
            v = [x for x in v if rng.random() > rng.choice([0.0, 0.15, 0.3])]
            at = rng.randrange(len(w) + 1)
            w[at:at] = v
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (None, "Under the MIT License"), (3, docs[3][1]), (202, "CC BY-NC " * 5000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(7))
    got = licenses.scan(d).collect()
    have = sorted(
        [(r["doc_id"], r["n_words"], [(p["start"], p["label"]) for p in r["places"]], r["labels"], round(r["score"], 9)) for r in got], key=repr
    )
    want = []
    for i, t in docs:
        n, places, labels, score = plain_scan(t, templates, len(licenses.BASE), licenses.THRESHOLD)
        want.append((i, n, places, labels, round(score, 9)))
    assert have == sorted(want, key=repr)
    assert licenses.scan(d.limit(0)).count() == 0


def scan_all(spark, texts, notices=licenses.NOTICES):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan(frame, notices=notices).collect()}


def test_whole_license_texts_are_found(spark):
    rng = random.Random(6)
    long = [f"word{rng.randrange(10_000)}" for _ in range(300)]
    most = [w for w in long if w not in set(rng.sample(sorted(set(long)), len(set(long)) // 6))]
    few = [w for w in long if w not in set(rng.sample(sorted(set(long)), len(set(long)) // 3))]
    notices = [licenses.Template("long", " ".join(long)), *licenses.NOTICES]
    filler = ["filler"] * 333
    texts = [" ".join(filler + long + filler), " ".join(filler + most), " ".join(filler + few)]
    got = scan_all(spark, texts, notices)
    assert [got[i]["labels"] for i in range(3)] == [["long"], ["long"], []]
    assert got[0]["score"] == 1.0 and 0.8 <= got[1]["score"] < 1


def test_notices_that_contain_each_other(spark):
    notice = "This work is licensed under a Creative Commons Attribution {}4.0 International License"
    got = scan_all(spark, [notice.format(x) for x in ("", "ShareAlike ", "NonCommercial ")])
    assert [got[i]["labels"] for i in range(3)] == [["cc-by"], ["cc-by-sa"], ["cc-by-nc"]]
