"""Line edit join, SimHash groups and components against plain versions."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from evenlend.llm import components as components_module, linededup, simhash
from evenlend.llm.components import components


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + i, 150) for i in range(40)] + [(300, 300), (301, 302), (302, 301)]
    pairs += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    got = components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert len(got) == len(linked)
    assert {r["node"]: r["component"] for r in got} == {n: r for n, r in roots({n for p in pairs for n in p}, pairs).items() if n in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_few_links_need_no_exchange(spark, monkeypatch):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 430)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(31)
    rounds, cut = [], components_module.cut_lineage
    monkeypatch.setattr(components_module, "cut_lineage", lambda df: rounds.append(df) or cut(df))
    few = {tuple(r) for r in components(links, "a", "b").collect()}
    one = [df.rdd.getNumPartitions() for df in rounds[1:]]
    rounds.clear()
    assert few == {tuple(r) for r in components(links, "a", "b", few=0).collect()}
    assert one and set(one) == {1}
    assert len(rounds) == len(one) + 1


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        last, row[0] = row[0], i + 1
        for j, b in enumerate(y):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (a != b))
    return row[-1]


def mutate(rng, line, n):
    w = list(line)
    for _ in range(n):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[at] = rng.choice("abcxyzé")
        elif kind == 1:
            w.insert(at, rng.choice("abcxyzé"))
        else:
            del w[at]
    return "".join(w)


def test_bit_vectors_match_edit_distance(spark):
    rng = random.Random(21)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("a", "a"), ("😀b", "b😀"), ("é" * 300, "é" * 299 + "x"), ("ab\U0001F600c", "abc"), ("e\u0301x", "éx"), (None, "a")]
    for _ in range(600):
        x = "".join(rng.choices("abé", k=rng.randrange(1, 14)))
        pairs.append((x, mutate(rng, x, rng.randrange(min(5, len(x))))))
        pairs.append((x, "".join(rng.choices("abé", k=rng.randrange(0, 14)))))
    frame = spark.createDataFrame(pairs, "x string, y string")
    for k in (1, 2, 4):
        got = frame.select("x", "y", linededup.within_edits(F.col("x"), F.col("y"), k).alias("near")).collect()
        assert len(got) == len(pairs)
        for r in got:
            assert r["near"] == (None if r["x"] is None else edits(r["x"], r["y"]) <= k), r


def test_long_lines_are_split_once(spark):
    near = linededup.within_edits(F.col("x"), F.col("y"))
    assert str(near).count("split(") == 2  # inside a lambda a split runs again for every character
    rng = random.Random(22)
    line = "".join(rng.choices("abcdé ", k=20_000))
    pairs = [(line, line[:9_000] + "q" + line[9_000:]), (line, line[2:]), (line, line[3:]), (line, "x" + line[1:-1] + "xy")]
    assert [r[0] for r in spark.createDataFrame(pairs, "x string, y string").select(near).collect()] == [True, True, False, False]


def test_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_ROWS", 3)
    test_line_join_matches_all_pairs(spark)


def line_docs():
    rng = random.Random(11)
    seeds = ["".join(rng.choices("abcdé ", k=rng.randrange(18, 60))) for _ in range(12)]
    docs = []
    for i in range(50):
        lines = [mutate(rng, s, rng.randrange(4)) for s in rng.sample(seeds, 3)] + [rng.choice(["", "short", "shorx", seeds[0]])]
        docs.append((i, "\n".join(lines)))
    return docs + [(90, None), (91, ""), (92, "\n\n"), (None, docs[3][1]), (5, docs[5][1]), (93, "é" * 5000 + "\n" + "é" * 4999)]


def test_line_join_matches_all_pairs(spark):
    docs = line_docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line_no", F.lit(9)).withColumn("links", F.lit("x"))
    got = linededup.line_classes(frame).collect()
    places = [(i, n, line) for i, t in docs if t is not None for n, line in enumerate(t.split("\n"))]
    assert len(got) == len(places)
    texts = sorted({line for _, _, line in places})
    near = [
        (x, y)
        for i, x in enumerate(texts)
        for y in texts[i + 1 :]
        if min(len(x), len(y)) >= linededup.MIN_CHARS and abs(len(x) - len(y)) <= 2 and (edits(x, y) <= 2 if len(x) < 1000 else True)
    ]
    assert near
    text_at = {(i, n): line for i, n, line in places}
    group = roots(texts, near)
    order = lambda i, n: (i is None, i or 0, n)
    for r in got:
        line = text_at[r["doc_id"], r["line_no"]]
        assert r["copies"] == sum(x == line for _, _, x in places)
        assert r["links"] == sum(line in p for p in near)
        first = min((order(i, n) for i, n, x in places if group[x] == group[line]))
        assert order(r["group_at"]["doc_id"], r["group_at"]["line_no"]) == first
        assert r["first"] == (order(r["doc_id"], r["line_no"]) == first)


def test_dedup_lines_keeps_first_of_each_group(spark):
    docs = [(1, "this is a line of some length\nunique one here"), (2, "this is a line of some lengths\nanother thing"), (3, "unique one here"), (4, ""), (5, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("bigint")).withColumn("gone", F.lit(1))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in linededup.dedup_lines(frame).collect()}
    assert got == {1: (docs[0][1], len(docs[0][1])), 2: ("another thing", 13), 4: ("", 0), 5: (None, None)}
    assert linededup.dedup_lines(frame).columns == frame.columns
    assert linededup.dedup_lines(frame.limit(0)).count() == 0


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in [None, "", " \t\n", "One", "one two", "A b C d", "ä ö ü x\x1fy z " * 50, "word " * 30000]:
        assert simhash.fingerprint(text) == plain_print(text)


def test_links_of_many_close_fingerprints(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = []
    for c in centres:
        for _ in range(20):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            codes.append(x)
    codes = sorted({*codes, 0, (1 << 64) - 1, 1})
    fps = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    pairs = [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 4]
    want = roots(codes, pairs)
    for node_rows, count in ((simhash.NODE_ROWS, None), (7, None), (7, 5), (40, 6), (simhash.NODE_ROWS, 8)):
        links = simhash.fingerprint_links(fps, node_rows=node_rows, count=count).collect()
        unsigned = lambda v: v % (1 << 64)
        got = roots(codes, [(unsigned(r["a"]), unsigned(r["b"])) for r in links])
        assert got == want


def test_fields_grow_with_the_fingerprints():
    assert [simhash.field_count(n) for n in (0, 10**6, 10**8, 10**11, 10**12, 10**14)] == [5, 5, 6, 7, 8, 9]
    for count in (5, 6, 7, 8):
        assert all(simhash.masks(count)[0] >> b & 1 for b in range(10))
        rows = 2048 << min(m.bit_count() for m in simhash.masks(count))
        assert simhash.field_count(rows) == count < simhash.field_count(rows + 1)
    rng = random.Random(5)
    for _ in range(300):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert all(any(diff & m == 0 for m in simhash.masks(count)) for count in (5, 6, 7, 8))


def test_tree_prunes_no_link():
    """Every leaf with a linked member is reached, and on spread codes most others are not."""
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) & np.uint64((1 << 18) - 1) | np.uint64(5 << 40)
    codes = np.unique(codes)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    levels, reached = simhash._tree(codes), 0
    for i in range(len(levels[0].starts)):
        got = simhash._reached(levels, i, 2)
        reached += len(got)
        mine = codes[i * simhash.LEAF : (i + 1) * simhash.LEAF]
        linked = np.flatnonzero((np.bitwise_count(mine[:, None] ^ codes[None, :]) <= 2).any(axis=0)) // simhash.LEAF
        assert set(linked[linked >= i]) <= set(got.tolist())
    assert reached < len(levels[0].starts) ** 2 / 3


def test_near_duplicates(spark):
    base = "The quick brown fox jumps over the lazy dog while nine other animals look at it from behind the old red barn " * 6
    docs = [(5, base), (3, base.upper()), (9, base + " end"), (7, "something else entirely with other words in it"), (1, None), (2, ""), (None, base), (None, "alone here now"), (9, base + " end")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit(0)).withColumn("component_id", F.lit("c"))
    got = sorted([(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()], key=repr)
    prints = [plain_print(t) for _, t in docs]
    pairs = [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 4]
    up = roots(prints, pairs)
    least = {g: min((i for (i, _), p in zip(docs, prints) if up[p] == g and i is not None), default=None) for g in up.values()}
    assert got == sorted([(i, least[up[p]]) for (i, _), p in zip(docs, prints)], key=repr)
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert kept.count() == len(set(up.values()))
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
