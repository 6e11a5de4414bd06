"""Operator 1: license scans as an exact set-similarity join of text blocks with license templates.

A text is cut into overlapping blocks of ``BLOCK`` words, ``BLOCK / 2`` apart, so every span of up to ``BLOCK / 2`` words
lies in a block; templates of more words, such as whole license texts, are looked for in longer blocks, of a power of two of at least
twice their words. A template matches a block if at least ``threshold`` of its distinct words are in the block. Of two
templates that match a block and of which one has all words of the other, the longer one counts if the words that tell them apart are
all there, else the shorter one.

Join method, with the words of all templates as the universe (other words cannot add to an overlap):

1. One pass counts, over all texts, in how many texts each template word occurs. That is the global order, rarest first.
2. Prefix filter: a match needs ``alpha = ceil(threshold * |template|)`` shared words, so it shares one of the template's
   ``|template| - alpha + 1`` rarest words with the block's ``|block| - alpha + 1`` rarest ones. The index of those
   template words is probed; blocks without any are never built.
3. Length filter: the block has at least ``alpha`` template words. Positional filter: the shared word's places in both
   orders must leave room for ``alpha`` shared words.
4. The overlap of what is left is counted exactly. Templates marked ``phrase`` need all their words and are then
   verified word by word: the places where they stand consecutively.

Templates are a parameter list, so the index is small and goes to every task; documents are scanned in place, nothing is
shuffled but one count per template word and task.

Defined cases: null texts count as empty and have no words, labels are then empty strings and the score is 0; null ids
stay; repeated rows give one row each; extra columns are ignored; equal labels of several templates are given once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import UPPER, WORD

BLOCK = 128
THRESHOLD = 0.8
_WORD = re.compile(WORD)
_LOWER = str.maketrans(UPPER, UPPER.lower())


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


# The base phrases and their labels.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

# Well-known sentences of public licenses, and one whole text.
NOTICES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http www apache org licenses LICENSE 2 0",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    Template("gpl-3", "GNU General Public License, version 3", True),
    Template("gpl-2", "GNU General Public License, version 2", True),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template("all-rights-reserved", "Copyright. All rights reserved. No part of this may be reproduced without written permission"),
)


def split_words(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []


@dataclass
class Found:
    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)  # start and label of every base phrase
    labels: set[str] = field(default_factory=set)
    score: float = 0.0


class Index:
    """Prefix index of templates under a global word order."""

    def __init__(self, templates: Sequence[Template], frequency: Mapping[str, int], threshold: float, base: int, block: int = BLOCK) -> None:
        self.templates, self.base, self.block = list(templates), base, block  # the first ``base`` report places
        self.words = [split_words(t.text) for t in self.templates]
        universe = sorted({w for ws in self.words for w in ws}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(universe)}
        self.sets = [sorted({self.rank[w] for w in ws}) for ws in self.words]
        self.alpha = [len(s) if t.phrase else max(1, math.ceil(threshold * len(s) - 1e-9)) for t, s in zip(self.templates, self.sets)]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (ranks, alpha) in enumerate(zip(self.sets, self.alpha)):
            for i, r in enumerate(ranks[: len(ranks) - alpha + 1]):
                self.prefix.setdefault(r, []).append((k, i))
        self.triggers = {w for w, r in self.rank.items() if r in self.prefix}
        held = [set() if t.phrase else set(s) for t, s in zip(self.templates, self.sets)]
        self.nested = [(a, b, held[b] - held[a]) for a in range(len(held)) for b in range(len(held)) if held[a] and held[a] < held[b]]

    def candidates(self, ranks: list[int]) -> set[int]:
        """Templates that pass the prefix, length and positional filters against a block's sorted distinct ranks."""
        found = set()
        for j, r in enumerate(ranks):
            for k, i in self.prefix.get(r, ()):
                alpha = self.alpha[k]
                if len(ranks) < alpha or j > len(ranks) - alpha:
                    continue
                if 1 + min(len(self.sets[k]) - i - 1, len(ranks) - j - 1) >= alpha:
                    found.add(k)
        return found

    def _nearest(self, shares: dict[int, float], held: set[int]) -> dict[int, float]:
        """Without the worse of matching templates that contain each other."""
        worse = {a if apart <= held else b for a, b, apart in self.nested if a in shares and b in shares}
        return {k: share for k, share in shares.items() if k not in worse}

    def scan(self, words: list[str]) -> Found:
        out = Found(len(words))
        hot = [i for i, w in enumerate(words) if w in self.triggers] if not self.triggers.isdisjoint(words) else []
        if not hot:
            return out
        half = self.block // 2
        last = max(0, (len(words) - 1) // half - 1) if len(words) > self.block else 0
        blocks = sorted({b for i in hot for b in (i // half - 1, i // half) if 0 <= b <= last})
        places = set()
        for b in blocks:
            part = words[b * half : b * half + self.block]
            held = {self.rank[w] for w in part if w in self.rank}
            shares = {}
            for k in self.candidates(sorted(held)):
                overlap = sum(r in held for r in self.sets[k])
                if overlap < self.alpha[k]:
                    continue
                if self.templates[k].phrase:
                    phrase = self.words[k]
                    at = [i for i in range(len(part) - len(phrase) + 1) if part[i] == phrase[0] and part[i : i + len(phrase)] == phrase]
                    if not at:
                        continue
                    if k < self.base:
                        places.update((b * half + i, self.templates[k].label) for i in at)
                shares[k] = overlap / len(self.sets[k])
            for k, share in self._nearest(shares, held).items():
                out.labels.add(self.templates[k].label)
                out.score = max(out.score, share)
        out.places = sorted(places)
        return out


class Scanner:
    """One index per block length; the first ``base`` templates report places."""

    def __init__(self, templates: Sequence[Template], frequency: Mapping[str, int], threshold: float, base: int, block: int = BLOCK) -> None:
        groups: dict[int, list[tuple[int, Template]]] = {}
        for i, t in enumerate(templates):
            long = max(block, 1 << (2 * len(split_words(t.text)) - 1).bit_length())
            groups.setdefault(long, []).append((i, t))
        self.indexes = [Index([t for _, t in own], frequency, threshold, sum(i < base for i, _ in own), size) for size, own in sorted(groups.items())]

    def scan(self, text: str | None) -> Found:
        words = split_words(text)
        out = Found(len(words))
        for index in self.indexes:
            found = index.scan(words)
            out.places = sorted({*out.places, *found.places})
            out.labels |= found.labels
            out.score = max(out.score, found.score)
        return out


def word_frequency(docs: DataFrame, templates: Sequence[Template]) -> dict[str, int]:
    """In how many texts each template word occurs; one row per template word reaches the driver."""
    wanted = {w for t in templates for w in split_words(t.text)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(wanted.intersection(split_words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id, n_words, places`` (start and label of every base phrase), ``labels`` (array), ``score``.

    The score is the largest share of a matched template's distinct words that one block holds, 0 without a match.
    """
    templates = [*base, *notices]
    index = Scanner(templates, word_frequency(docs, templates), threshold, len(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            found = [index.scan(t.as_py()) for t in batch.column(1)]
            columns = [
                pa.array([f.n_words for f in found], pa.int64()),
                pa.array([[{"start": s, "label": n} for s, n in f.places] for f in found], place),
                pa.array([sorted(f.labels) for f in found], pa.list_(pa.string())),
                pa.array([f.score for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "places", "labels", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words bigint, places array<struct<start:bigint,label:string>>, labels array<string>, score double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
