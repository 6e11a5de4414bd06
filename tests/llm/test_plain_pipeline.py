"""run() of the pipeline against a plain version of all its stages, without Spark."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from evenlend.llm import language, packing

from test_duplicates import edits, mutate, roots
from test_near_copies import jaccard, plain_shingles

SEQUENCE = 4096


def letters(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def grams(word, n):
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def plain_language(docs):
    counts = {}
    for i, text, lang in docs:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for w in letters(text):
                counts.setdefault((lang, 0), Counter())[w] += 1
                for n in range(1, 5):
                    counts.setdefault((lang, n), Counter()).update(grams(w, n))
    langs = sorted({lang for lang, _ in counts})
    penalty = 1 + math.log10(max(sum(c.values()) for c in counts.values()))

    def cost(lang, n, x):
        c = counts[lang, n]
        return -math.log10(c[x] / sum(c.values())) if x in c else penalty

    def word_cost(w):
        if any(w in counts[lang, 0] for lang in langs):
            return [cost(lang, 0, w) for lang in langs]
        for n in range(4, 0, -1):
            known = [g for g in grams(w, n) if any(g in counts[lang, n] for lang in langs)]
            if known:
                return [sum(cost(lang, n, g) for g in known) / len(known) for lang in langs]
        return [penalty] * len(langs)

    def evidence(w, lang):
        found = grams(w, 4) if len(w) + 1 >= 4 else []
        return 1.0 if w in counts[lang, 0] else sum(g in counts[lang, 4] for g in found) / len(found) if found else 0.0

    kept = []
    for i, text, lang in docs:
        w = letters(text)
        if w:
            mean = np.mean([word_cost(x) for x in w], axis=0)
            best = langs[int(np.argmin(mean))]
            if sum(evidence(x, best) for x in w) / len(w) >= language.LEAST_EVIDENCE:
                kept.append((i, text, lang))
    return kept


def plain_lines(docs):
    places = [(i, n, line) for i, text, _ in docs for n, line in enumerate(text.split("\n"))]
    texts = sorted({line for _, _, line in places})
    letters_of = {t: Counter(t) for t in texts}

    def near(x, y):
        if min(len(x), len(y)) < 20 or abs(len(x) - len(y)) > 2:
            return False
        a, b = letters_of[x], letters_of[y]
        return sum((a - b).values()) + sum((b - a).values()) <= 4 and edits(x, y) <= 2

    group = roots(texts, [(x, y) for k, x in enumerate(texts) for y in texts[k + 1 :] if near(x, y)])
    first = {}
    for i, n, line in places:
        first[group[line]] = min(first.get(group[line], (i, n)), (i, n))
    out = []
    for i, text, lang in docs:
        lines = text.split("\n")
        kept = [x for n, x in enumerate(lines) if x == "" or first[group[x]] == (i, n)]
        if len(kept) == len(lines) or any(kept):
            out.append((i, "\n".join(kept), lang))
    return out


def plain_copies(docs):
    sets = [plain_shingles(text) for _, text, _ in docs]
    pairs = [(a, b) for a in range(len(docs)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    group = roots(range(len(docs)), pairs)
    least = {}
    for k, (i, _, _) in enumerate(docs):
        least[group[k]] = min(least.get(group[k], i), i)
    return [d for k, d in enumerate(docs) if least[group[k]] == d[0]]


def plain_clean(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for text in items:
        w = split(text)
        windows |= {tuple(w[s : s + 10]) for s in range(max(1, len(w) - 9))} - {()}
    held = lambda w: any(tuple(w[s : s + n]) in windows for n in {len(x) for x in windows} for s in range(len(w) - n + 1))
    return [d for d in docs if not held(split(d[1]))]


def corpus():
    rng = random.Random(31)
    alphabet = {"aa": "abdeghilnorst", "bb": "ceikmopuvwyz", "cc": "äfgjlöqrsüx"}
    vocabulary = {lang: ["".join(rng.choices(a, k=rng.randrange(4, 9))) for _ in range(400)] for lang, a in alphabet.items()}
    say = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    items = [say("aa", 25), say("bb", 14), "Only, four words here", "", None]
    notice = {lang: say(lang, 12) for lang in vocabulary}
    docs = []
    for lang in vocabulary:
        for _ in range(25):
            lines = [say(lang, rng.randrange(6, 30)) for _ in range(rng.randrange(1, 5))]
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", notice[lang], mutate(rng, notice[lang], 2)]))
            docs.append(("\n".join(lines), lang))
        for _ in range(4):
            words = say(lang, 150).split()
            docs.append((" ".join(words), lang))
            for _ in range(2):
                edited = list(words)
                edited[rng.randrange(150)] = "".join(rng.choices(alphabet[lang], k=12))
                docs.append((" ".join(edited), lang if rng.random() < 0.5 else None))
    docs += [(say("aa", 20) + " " + items[0].upper() + " " + say("aa", 5), "aa"), (say("bb", 9) + ". only four, words here", "bb")]
    docs += [(" ".join(items[1].split()[2:12]) + " " + say("bb", 40), None), (" ".join(items[0].split()[:9]) + " " + say("aa", 40), "aa")]
    docs += [(" ".join("".join(rng.choices("дежзийклм", k=6)) for _ in range(30)), None) for _ in range(5)]
    docs += [(None, "aa"), ("", "bb"), ("12 34 !!", None), ("\n\n", None), (notice["aa"] + "\n" + notice["aa"], "aa"), (docs[0][0], "aa"), (say("cc", 2500), "cc")]
    rng.shuffle(docs)
    return [(i * 3 + 1, text, lang) for i, (text, lang) in enumerate(docs)], items


def test_run_equals_a_plain_version(spark, tmp_path):
    docs, items = corpus()
    rows = [(i, text, lang, "s", None if text is None else len(text)) for i, text, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    steps = [docs, plain_language(docs)]
    steps.append(plain_lines(steps[-1]))
    steps.append(plain_copies(steps[-1]))
    steps.append(plain_clean(steps[-1], items))
    assert all(len(a) > len(b) for a, b in zip(steps, steps[1:]))
    assert len(steps[0]) - len(steps[1]) == 9  # foreign texts and texts without a letter
    assert len(steps[3]) - len(steps[4]) == 3

    tokens = Tokenizer.from_file(packing.vocabulary_path())
    want = {}
    for i, text, _ in steps[-1]:
        want[i] = [*tokens.encode(text, add_special_tokens=False).ids, packing.END_ID]
    sequences, got = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(got) == set(want)
    for i, pieces in got.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            ids = want[i][at : at + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(want[i]))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(want[i])
    for placed in sequences.values():
        ends = np.cumsum([n for _, n in sorted(placed)]).tolist()
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= SEQUENCE
