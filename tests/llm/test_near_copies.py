"""The near-duplicate stage: scattered word edits at 0.80-0.95 against all pairs."""

import random

import numpy as np

import corpus_pipeline
from evenlend.llm import nearcopies

from test_duplicates import roots


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted(rng, texts=120):
    rows = []
    for _ in range(texts):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(120, 400))]
        rows.append(" ".join(w))
        low = rng.choice([0.72, 0.80, 0.85, 0.90])
        edited, source = list(w), plain_shingles(" ".join(w))
        while True:
            at = rng.randrange(len(edited))
            tried = edited[:at] + [f"x{rng.randrange(10**6)}"] + edited[at + 1 :]
            if jaccard(source, plain_shingles(" ".join(tried))) < low:
                break
            edited = tried
        rows.append(" ".join(edited))
    return rows


def expected(rows):
    sets = [plain_shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    group = roots(range(len(rows)), pairs)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[group[i]] = min(best.get(group[i], (True, 0)), (d is None, d or 0))
    return sorted(best.values()), len(pairs)


def test_scattered_edits(spark):
    texts = planted(random.Random(3)) + ["", "  ", None, "one two", "One  TWO", "one two three"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone with no id"), (0, texts[0])]
    want, linked = expected(rows)
    assert linked > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.dedup_documents(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == want
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in nearcopies.drop_near_copies(docs, block=1).collect()) == want
    assert corpus_pipeline.dedup_documents(spark, docs.limit(0), "").count() == 0


def test_large_group_in_blocks(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(150)] = f"y{i}"
        rows.append((i, " ".join(w)))
    got = nearcopies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=7).collect()
    assert [r["doc_id"] for r in got] == [0]


def chain(rng, links):
    """Texts of which each is a near copy of the one before and few of the first."""
    w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    out = [" ".join(w)]
    for i in range(links):
        for at in range(7 * i, 7 * i + 7):
            w[at % 200] = f"z{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_chains_and_shared_boilerplate(spark):
    """Groups held together by chains are found whole; texts that share half their shingles stay apart."""
    rng = random.Random(12)
    shared = " ".join(f"b{i}" for i in range(120))
    texts = [t for _ in range(4) for t in chain(rng, 12)]
    texts += [shared + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(90)) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want, linked = expected(rows)
    assert linked > 40 and len(want) < len(rows) - 20
    for block in (nearcopies.BLOCK, 3):
        got = nearcopies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
        assert sorted((False, r["doc_id"]) for r in got) == want


def test_unit_links_match_all_pairs():
    rng = np.random.RandomState(0)
    base = [rng.randint(0, 1 << 40, 100).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.where(rng.rand(100) < rng.choice([0, 0.05, 0.1, 0.15]), rng.randint(0, 1 << 40, 100).astype(np.uint64), base[i % 6])) for i in range(60)]
    side = np.arange(60) % 2
    for within in (True, False):
        near = [(i, j) for i in range(60) for j in range(i) if (within or side[i] != side[j]) and jaccard(set(sets[i]), set(sets[j])) >= 0.8]
        assert roots(range(60), nearcopies.unit_links(sets, side, within)) == roots(range(60), near)
        known = np.array([0 if i < 20 else i for i in range(60)])
        joined = [(i, 0) for i in range(20)]
        assert roots(range(60), nearcopies.unit_links(sets, side, within, known=known) + joined) == roots(range(60), near + joined)


def test_candidates_come_through_the_simhash_index(spark, monkeypatch):
    """The stage asks the index of simhash; its pairs connect exactly what lies within the bit bound."""
    asked, real = [], nearcopies.fingerprint_links
    monkeypatch.setattr(nearcopies, "fingerprint_links", lambda *a, **k: asked.append(a[1]) or real(*a, **k))
    rng = random.Random(8)
    texts = sorted(set(planted(rng, 60) + ["one two", "ONE two", "one two three"]))
    rows = list(enumerate(texts))
    want, _ = expected(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.dedup_documents(spark, docs, "").collect()
    assert asked == [nearcopies.MAX_BITS] and sorted((False, r["doc_id"]) for r in got) == want

    marks = {i: nearcopies.majority(nearcopies.shingles(t)) for i, t in rows}
    near = [(i, j) for i in marks for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= nearcopies.MAX_BITS]
    signed = [(i, m - (1 << 64) if m >> 63 else m) for i, m in marks.items()]
    pairs = [(r["first"], r["key"]) for r in nearcopies.index_pairs(spark.createDataFrame(signed, "key long, fp long")).collect()]
    assert len(near) > 10 and set(pairs) <= {(j, i) for i, j in near}
    assert roots(range(len(rows)), pairs) == roots(range(len(rows)), near)
