"""License scans by a positional index of rare words.

Templates are licence wordings: the base phrases, notices that name a licence with its version, and opening paragraphs of
licence texts. Each has mandatory key phrases. The index has, for each key phrase, the postings (phrase, position in it) of
its RARE rarest words, by inverse document frequency over all documents. It is exact: a phrase can only stand where its rare
words stand at their relative positions.

Scan. A file's licence words are found with their positions. Each rare word at position p with a posting at position q makes p - q
a start of the phrase; the starts of the phrase's rare words are intersected, rarest first, and what is left is verified word by word. Places of the base
phrases are whole templates. Of other templates, each place of the first key phrase gives an alignment: the other key
phrases must stand within SLACK words of their places, and the template's score is the share, weighted by inverse document
frequency, of its words that stand within SLACK of theirs. From LEAST_SCORE on the template's label is given.

Two passes over the documents: frequencies (one row for each licence word reaches the driver), then the scan. Nothing is
shuffled by word, so frequent words are no hot keys. Long texts are cut into words SLICE_BYTES at a time; only licence
words' positions are held.

Defined results. A null or empty text has no words, no labels and the score 0. Rows that repeat a doc_id each get a
row; a null doc_id stays. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import text_bytes

RARE, SLACK, LEAST_SCORE = 2, 4, 0.7
SLICE_BYTES = 1 << 20

# A word's bytes, and the base phrases with their labels.
_WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Label, wording, key phrases of public licences.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("except in compliance with the license",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0", ("spdx license identifier gpl 2 0",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0", ("spdx license identifier gpl 3 0",)),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("redistribute it and or modify it", "free software foundation")),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "this software and associated documentation files")),
    ("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification are permitted")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights", ("waived all copyright and related",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("proprietary", "All rights reserved. No part may be reproduced without written permission", ("all rights reserved", "without written permission")),
)

_LOWERED = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).lower())


def words(text: str) -> tuple[bytes, ...]:
    return tuple(text.encode().translate(_LOWERED).split())


def word_slices(text: bytes, most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """A text's words, those of about ``most`` bytes at a time."""
    start = 0
    while len(text) - start > most:
        cut = _NO_WORD.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()].translate(_LOWERED).split()
        start = cut.end()
    yield (text[start:] if start else text).translate(_LOWERED).split()


_NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


@dataclass(frozen=True)
class Template:
    label: str
    wording: tuple[bytes, ...]
    #: key phrases, each at its place in the wording
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]
    base: bool = False


def template(label: str, wording: str, keys: tuple[str, ...], base: bool = False) -> Template:
    own, placed = words(wording), []
    for key in map(words, keys):
        at = [i for i in range(len(own) - len(key) + 1) if own[i : i + len(key)] == key]
        if not key or not at:
            raise ValueError(f"{b' '.join(key)!r} does not stand in the wording of {label}")
        placed.append((at[0], key))
    return Template(label, own, tuple(placed), base)


TEMPLATES = (*(template(label, p, (p,), True) for label, p in BASE), *(template(*n) for n in NOTICES))


class Index:
    """Postings of the rare words of all key phrases, given how many of ``n_docs`` documents have each licence word."""

    def __init__(self, templates: tuple[Template, ...], n_docs: int, documents: dict[bytes, int], rare: int = RARE):
        self.templates = templates
        vocabulary = sorted({w for t in templates for w in t.wording})
        self.weight = {w: 1 + math.log((n_docs + 1) / (documents.get(w, 0) + 1)) for w in vocabulary}
        self.phrases = sorted({key for t in templates for _, key in t.keys})
        self.vocabulary = frozenset(vocabulary)
        self.rare, self.postings = [], {}
        for i, phrase in enumerate(self.phrases):
            ranked = sorted(range(len(phrase)), key=lambda q: (-self.weight[phrase[q]], phrase[q], q))[:rare]
            self.rare.append(ranked)
            for q in ranked:
                self.postings.setdefault(phrase[q], []).append((i, q))
        number = {p: i for i, p in enumerate(self.phrases)}
        self.keys = [[(offset, number[key]) for offset, key in t.keys] for t in templates]
        self.whole = [sum(self.weight[w] for w in t.wording) for t in templates]

    def places(self, at: dict[bytes, list[int]]) -> list[list[int]]:
        """Where each key phrase stands, given the positions of the file's licence words."""
        found: list[list[int]] = [[] for _ in self.phrases]
        asked = {i for w in at if w in self.postings for i, _ in self.postings[w]}
        for i in asked:
            phrase = self.phrases[i]
            if any(w not in at for w in phrase):
                continue
            starts = None
            for q in self.rare[i]:
                here = {p - q for p in at[phrase[q]]}
                starts = here if starts is None else starts & here
                if not starts:
                    break
            found[i] = sorted(s for s in starts if all(_stands(at[w], s + q, 0) for q, w in enumerate(phrase) if q not in self.rare[i]))
        return found

    def score(self, k: int, at: dict[bytes, list[int]], places: list[list[int]]) -> float:
        """Of template ``k``, the largest share of its words in place over all alignments with all key phrases; 0 without any."""
        t, best = self.templates[k], 0.0
        (first, lead), *others = self.keys[k]
        for place in places[lead]:
            start = place - first
            if all(_stands(places[i], start + offset, SLACK) for offset, i in others):
                got = sum(self.weight[w] for q, w in enumerate(t.wording) if w in at and _stands(at[w], start + q, SLACK))
                best = max(best, got / self.whole[k])
                if best >= 1:
                    return 1.0
        return best


def _stands(positions: list[int], at: int, slack: int) -> bool:
    i = bisect_left(positions, at - slack)
    return i < len(positions) and positions[i] <= at + slack


def _document(index: Index, text: bytes) -> tuple:
    at: dict[bytes, list[int]] = {}
    n = 0
    for part in word_slices(text):
        if not index.vocabulary.isdisjoint(part):
            for i, w in enumerate(part, n):
                if w in index.vocabulary:
                    at.setdefault(w, []).append(i)
        n += len(part)
    if index.postings.keys().isdisjoint(at):
        return n, 0, None, None, [], [], 0.0
    places, base, own, best, stand = index.places(at), set(), set(), 0.0, []
    for k, t in enumerate(index.templates):
        if t.base:
            if here := places[index.keys[k][0][1]]:
                base.add(t.label)
                stand += [len(here), here[0], here[-1]]
                best = 1.0
        else:
            score = index.score(k, at, places)
            best = max(best, score)
            if score >= LEAST_SCORE:
                own.add(t.label)
    n_base, firsts, lasts = sum(stand[::3]), stand[1::3], stand[2::3]
    return n, n_base, min(firsts, default=None), max(lasts, default=None), sorted(base), sorted(base | own), min(best, 1.0)


def frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of documents with each licence word."""
    vocabulary = frozenset(w for t in templates for w in t.wording)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for b in batches:
            for text in text_bytes(b.column(0)):
                total[b""] += 1
                seen = set()
                for part in word_slices(text):
                    seen |= vocabulary.intersection(part)
                total.update(seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    # one row for each licence word at most, whatever the input
    found = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in found}
    return counts.pop(b"", 0), counts


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (both arrays) and score of each row."""
    index = Index(templates, *frequencies(docs, templates))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_document(index, t) for t in text_bytes(b.column(1))]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found), kinds)] if found else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"
    return docs.select("doc_id", "text").mapInArrow(scan, ddl)


def digest(found: DataFrame) -> DataFrame:
    """Labels as comma-joined strings."""
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
