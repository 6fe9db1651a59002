"""License scans against regular expressions and a scan of every place."""

import math
import re

from tracewell.llm import license_index, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def base(text):
    own = plain_words(text)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    at = sorted(i for i, _ in places)
    return len(own), len(at), at[0] if at else None, at[-1] if at else None, sorted({label for _, label in places})


def brute(texts):
    """Every template tried at every place, with frequencies counted in plain sets."""
    docs = [plain_words(t) for t in texts]
    rows = []
    templates = [(t.label, [w.decode() for w in t.wording], [(o, [w.decode() for w in k]) for o, k in t.keys]) for t in license_index.TEMPLATES if not t.base]
    weight = {}
    for _, wording, _ in templates:
        for w in wording:
            weight.setdefault(w, 1 + math.log((len(docs) + 1) / (sum(w in set(d) for d in docs) + 1)))
    for text, own in zip(texts, docs):
        known = base(text)
        labels, best = set(known[4]), 1.0 if known[4] else 0.0
        for label, wording, keys in templates:
            for start in range(-len(wording), len(own)):
                near = lambda k, at, slack: any(i >= 0 and own[i : i + len(k)] == k for i in range(at - slack, at + slack + 1))
                if all(near(k, start + o, 0 if j == 0 else license_index.SLACK) for j, (o, k) in enumerate(keys)):
                    share = sum(weight[w] for q, w in enumerate(wording) if near([w], start + q, license_index.SLACK)) / sum(weight[w] for w in wording)
                    best = max(best, min(share, 1.0))
                    if share >= license_index.LEAST_SCORE:
                        labels.add(label)
        rows.append((*known[:4], ",".join(known[4]), ",".join(sorted(labels)), best))
    return rows


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g)[1:7] == w[:6] and abs(g["score"] - w[6]) < 1e-9, (g, w)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    got = sorted(queries.QUERIES["op11_license_scan"](spark, sf).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [i for i, _ in docs]
    same(got, brute([t for _, t in docs]))
    assert any(r.n_base for r in got)


def test_edges(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")"
    texts = [
        None,
        "",
        "... --- ...",
        "MIT License mit-license MIT. LICENSE",
        "license mit apache the license cc apache  license\x00by cc\nby cc_by-nc",
        "CC BY-NC 4.0, and CC-BY 4.0",
        "Аpache License, apache licensé, apachelicense, gnu general public licenses",
        "gnu gnu general public license general public license gnu general public license",
        mit,
        mit.replace("free of charge, ", ""),
        mit.replace("obtaining a copy of", "who gets the one copy of"),
        "Redistribution and use in source and binary forms, with or without\n * modification, are permitted",
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License, version 3",
        "\U0001f600 apache \U0001f600 license, apache license",
        "All rights reserved. It was a fine day, with nothing to do and without written permission.",
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[5], None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = license_index.digest(license_index.scanned(frame)).collect()
    order = {tuple(r)[:2]: r for r in rows}
    assert len(got) == len(rows) and len(order) == len(texts) + 1
    same(got, brute([t for _, t, _ in rows]))
    assert license_index.scanned(frame.limit(0)).collect() == []


def test_long_text(spark):
    """Phrases across the seams of slices, many places, one giant word."""
    text = "word " * 300_000 + "apache license " + "x" * 3_000_000 + " cc by " + "mit license " * 50_000
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = license_index.digest(license_index.scanned(frame)).first()
    assert tuple(got) == (1, *base(text)[:4], "apache,cc-by,mit", "apache,cc-by,mit", 1.0)
    for most in (1, 7, 64):
        assert [w for part in license_index.word_slices(b"MIT License, apache\x00license " * 9, most) for w in part] == [b"mit", b"license", b"apache", b"license"] * 9
