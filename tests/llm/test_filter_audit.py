"""Filter interactions against running every order on every document."""

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenlend.llm import filteraudit

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain_audit(docs, labels):
    """All orders applied to the documents themselves."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > first[text],
        }
        own = [(q, t) for j, q, t in labels if i is not None and j == i]
        rows.append((source or "", fails, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in mine) - len(gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), 0,
                ]
        for f in "ABCDE":
            keys = [(part, o, o.index(f) + 1) for o in map("".join, permutations("ABCDE"))]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k][6] = total
    return out


def as_rows(frame):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in frame.collect()}


def text_of(rng):
    kind = rng.randrange(6)
    words = [rng.choice("abcdefghij") * rng.randrange(1, 9) + rng.choice(["", "é", "É", "X", "#", "|"] if kind == 1 else [""]) for _ in range(rng.choice([0, 1, 49, 50, 51, 90]))]
    if kind == 2:
        words = [w.upper() for w in words]
    if kind == 3:
        words = [f"{w}{i}" for i, w in enumerate(words)]
    return rng.choice([" ", "\t", "\n ", "\x0b", "\x1c ", "  "]).join(words)


def test_every_step_equals_running_the_orders(spark):
    rng = random.Random(11)
    texts = [text_of(rng) for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(300)]
    docs += [(300 + i, texts[0], "a") for i in range(100)]  # a hot text
    docs += [(None, texts[0], "a"), (None, None, None), (5, docs[5][1], "b"), (5, docs[5][1], "b"), (401, None, "c"), (402, "", "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"mask": F.lit("m"), "part": F.lit(0), "identity": F.lit(1)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("first", F.lit(True))
    assert as_rows(filteraudit.audit_documents(frame, marks)) == plain_audit(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit_documents(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "some words", "x")], docs.schema)
    got = as_rows(filteraudit.audit_documents(one, labels))
    assert len(got) == 600 and got["x", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


@pytest.mark.parametrize("n", [1, 3, 6])
def test_walk_gives_survivors_of_every_subset(n):
    cells = np.random.default_rng(n).integers(0, 9, (4, 1 << n, 2))
    states = filteraudit.walk(cells)
    for subset in range(1 << n):
        rows = [m for m in range(1 << n) if not m & subset]
        assert (states[:, subset] == cells[:, rows].sum(axis=1)).all()


def test_very_long_text(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert filteraudit.text_masks(docs).first()["mask"] == 0
