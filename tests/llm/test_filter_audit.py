"""The filter audit against every order walked document by document."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np

from tracewell.llm import filter_audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """rows of (doc_id, text, lang) -> (part, set of filters failed) of each."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, lang in rows:
        t = t or ""
        own = WORD.findall(t)
        flags = {
            "A": len(own) < 200,
            "B": 100 * len(set(own)) < 50 * len(own),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > least[t],
        }
        out.append((lang or "", {f for f, x in flags.items() if x}))
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *q in labels if q[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for (i, _, _), (part, failing) in zip(rows, fails(rows)):
        parts[part].append((failing, i in good and i is not None, i in toxic and i is not None))
    out = []
    for part, docs in parts.items():
        shapley = Counter()
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            gone = []
            for k, f in enumerate(order):
                lost = [d for d in left if f in d[0]]
                redundant = sum(f in d[0] for d in gone)
                left, gone = [d for d in left if f not in d[0]], gone + lost
                shapley[f] += len(lost)
                steps.append((order, k + 1, f, len(left), len(lost), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in lost), sum(d[2] for d in lost)))
        out += [(part, o, k, *rest, shapley[f]) for o, k, f, *rest in steps]
    return sorted(out)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = queries.QUERIES["op13_filter_audit"](spark, sf)
    assert sorted(map(tuple, got.select(NAMES).collect())) == brute(rows, labels)


def test_edges(spark):
    words = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \t\n", words, words, words + "\x85x y \x1c", words.upper(), words + " #", "a b " * 200, "Aé中" * 10, "\x00 \x0b\x0c " * 120, words * 30]
    rows = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [(20 + i, words + " $ Z", "en") for i in range(40)] + [(3, words, "en"), (3, words, "en"), (None, words, None), (None, "solo", "fr")]
    labels = [(3, 1, 0), (3, 0, 1), (4, None, 1), (0, 1, 1), (None, 1, 1), (999, 1, 1), (21, 1, 0)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, quality string, mask int").repartition(3)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    for sizes in ({}, {"block_bytes": 3000, "slice_bytes": 200}):
        got = filter_audit.audit(docs, marks, **sizes)
        assert sorted(map(tuple, got.select(NAMES).collect())) == brute(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).collect() == []
    assert len(filter_audit.audit(docs, marks.limit(0)).collect()) == 600 * 4


def test_matrix(spark):
    """The shards are the document-term matrix under one dictionary."""
    texts = ["b a b", "", None, "c", "a " * 50, "zé b"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    dictionary, shards, _ = filter_audit.document_terms(docs, block_bytes=8, slice_bytes=4)
    number = {r.word: r.id for r in dictionary.collect()}
    assert set(number) == {"a", "b", "c", "zé"} and len(set(number.values())) == 4
    cells = {}
    for s in shards.collect():
        indptr, ids, counts = (np.frombuffer(s[c], kind).tolist() for c, kind in (("indptr", "<i8"), ("ids", "<i8"), ("counts", "<i4")))
        for r, a, b in zip(s.rows, indptr, indptr[1:]):
            assert ids[a:b] == sorted(ids[a:b])
            cells[r.doc_id] = dict(zip(ids[a:b], counts[a:b]))
    assert cells == {i: {number[w]: n for w, n in Counter((t or "").split()).items()} for i, t in enumerate(texts)}


def test_long_text():
    text = ("alpha beta " * 50_000 + "x" * 200_000 + "\tgamma ").encode()
    indptr, columns, counts, words = filter_audit.block_matrix([b"", text, b"beta"], 4096)
    named = dict(zip((w.as_py() for w in words), range(len(words))))
    assert indptr.tolist() == [0, 0, 4, 5]
    got = {columns[i]: counts[i] for i in range(4)}
    assert got == {named[b"alpha"]: 50_000, named[b"beta"]: 50_000, named[b"x" * 200_000]: 1, named[b"gamma"]: 1}
