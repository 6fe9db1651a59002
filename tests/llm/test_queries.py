"""The registered queries over the small tables, against brute force."""

import zlib
from collections import Counter, defaultdict

import hashlib
import numpy as np
import pytest
from test_hash_index import brute as nearest
from test_simhash import brute_components, brute_fp
from test_substring_dedup import brute as covered
from test_weak_rules import brute as counts
from tokenizers import Tokenizer

from tracewell.llm import bpe, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op2(spark, docs):
    got = queries.QUERIES["op2_suffix_array_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == covered(docs)


def test_op4(spark):
    want = nearest([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    got = queries.QUERIES["op4_multi_index_hashing"](spark, SF).collect()
    exact = {(q, i): s for q, near in want.items() for i, s in near}
    assert np.mean([(r.query_id, r.vec_id) in exact for r in got]) >= 0.9
    assert all(abs(exact.get((r.query_id, r.vec_id), r.score) - r.score) < 1e-12 for r in got)
    ranks = defaultdict(list)
    for r in got:
        ranks[r.query_id].append((r["rank"], -r.score, r.vec_id))
    assert set(ranks) == set(want) and all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in ranks.values())


def test_op5(spark, docs):
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    got = queries.QUERIES["op5_packing"](spark, SF).collect()
    pieces = defaultdict(list)
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    sequences = Counter()
    for r in got:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 2048 and sum(n < 2048 for n in sequences.values()) <= spark.sparkContext.defaultParallelism + 4


def test_op6(spark, docs):
    """Every score again, from features counted in plain loops and bins looked up one by one."""
    from test_quality_gam import plain_features, plain_score

    from tracewell.llm import quality_gam

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_gam.learned(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = {r.doc_id: r for r in queries.QUERIES["op6_quality_gam"](spark, SF).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, t in docs:
        want = plain_score(model, plain_features((t or "").encode()))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (want >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op7(spark, docs):
    """Every finding again: formats and checks in plain code, and a Feistel network of its own; then that nothing was missed."""
    from test_pii import plain_pseudonym, plain_values

    texts = dict(docs)
    got = queries.QUERIES["op7_pii_pseudonyms"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    n = 0
    for r in got:
        text = texts[r.doc_id]
        if text is None:
            assert r.text is None and not r.pii_found
            continue
        at, shift = 0, 0
        for f in sorted(r.pii_found, key=lambda f: f.start):
            value = text[f.start : f.end]
            want = plain_pseudonym(f.kind, value, pii.DEFAULT_KEY)
            assert text[at : f.start] == r.text[at + shift : f.start + shift]
            assert r.text[f.start + shift :][: len(want)] == want, (f.kind, value, want)
            shift += len(want) - len(value)
            at = f.end
            n += 1
        assert text[at:] == r.text[at + shift :]
        covered = {k for f in r.pii_found for k in range(f.start, f.end)}
        for a, e in plain_values(text):
            assert covered.issuperset(range(a, e)), text[max(0, a - 20) : e + 20]
    assert n


def test_op8(spark, docs):
    got = queries.QUERIES["op8_weak_quality_rules"](spark, SF).collect()
    assert sorted(tuple(r[:6]) for r in got) == sorted((i, *counts(t)) for i, t in docs)
    # votes, estimation and posterior again, over rows instead of patterns
    from test_weak_rules import plain_posteriors

    want = plain_posteriors([t for _, t in docs])
    by_id = {r.doc_id: r for r in got}
    for (i, _), p in zip(docs, want):
        assert abs(by_id[i].posterior - p) < 1e-6 and by_id[i].kept == (not by_id[i].base_failed and by_id[i].posterior >= 0.5)


def test_op9(spark, docs):
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, t in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, queries.QUERIES["op9_bpe_round_trip"](spark, SF).collect())) == sorted(want)


def test_op10(spark, docs):
    fps = [brute_fp(t) for _, t in docs]
    roots = brute_components([i for i, _ in docs], fps)
    got = queries.QUERIES["op10_simhash_near_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((d[0], f"{fps[k]:016x}", roots[k]) for k, d in enumerate(docs))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, passages = docs, None
    for name, f in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        if name == "suffix-array dedup":
            passages = {r[0]: r[4] for r in covered(list(before.items()))}
        kept = f(spark, kept, SF)
        assert kept.columns == docs.columns, name
        after = {r.doc_id: r.text for r in kept.collect()}
        assert set(after) <= set(before) and after, name
        if name == "suffix-array dedup":
            import hashlib as h

            whole = [i for i, t in after.items() if h.sha256((t or "").encode()).hexdigest() == passages[i]]
            assert len(whole) > 0.9 * len(after)  # the others had a character cut
            assert set(after) == set(before)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    want = {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept.collect()}
    total = Counter()
    for r in pipeline.run(spark, SF).collect():
        total[r.doc_id] += r.length
    assert dict(total) == want
    # what the stages leave: no near-duplicates, no repeated passages before pseudonyms
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert len({brute_fp(t) for _, t in texts}) == len(texts)


def test_pipeline_edges(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "pii_found", "__gam_score", "key", "n_chars", "a.b")
    ddl = "doc_id long, text string, " + ", ".join(f"`{n}` string" if n != "n_chars" else "n_chars int" for n in names)
    base = "call 988-555-2485 about the thing that we said before and will say again so that it is long enough "
    rows = [(1, base * 3), (1, base * 3), (1, "another text altogether, with other words in it, under the same id"), (2, base * 3), (3, None), (None, "no id here but words"), (4, ""), (5, "x" * 300_000), (6, "word " * 40_000)]
    extra = [("v" if n != "n_chars" else 7) for n in names]
    df = spark.createDataFrame([(*r, *extra) for r in rows], ddl)
    for frame in (df, df.limit(0)):
        n = frame.count()
        frame = spark.createDataFrame(frame.collect(), df.schema)
        for name, f in pipeline.STAGES[:-1]:
            f_docs = f
            kept = f_docs(spark, frame, SF) if name != "quality classifier" else pipeline._applied(frame, lambda d: pipeline.quality_gam.kept(d, labels))
            assert kept.columns == df.columns and kept.dtypes == df.dtypes, name
            got = kept.collect()
            assert all(r[c] == "v" for r in got for c in names if c not in ("n_chars",)), name
            if name == "SimHash near-dedup" and n:
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (False, 3), (False, 5), (False, 6), (True, 0)]
            frame = spark.createDataFrame(got, df.schema) if name != "quality classifier" else frame
        pieces = pipeline.pack(spark, frame, SF).collect()
        assert len({r.doc_id for r in pieces}) == (5 if n else 0)
        if n:
            assert "988-555-2485" not in "".join(r.text or "" for r in frame.collect())
    spark.conf.set(pipeline.KEY_CONF, "mine")
    try:
        mine = [r.text for r in pipeline.pseudonyms(spark, df, SF).collect()]
    finally:
        spark.conf.unset(pipeline.KEY_CONF)
    assert sorted(str(x) for x in mine) == sorted(str(None if t is None else pii.pseudonymised(t, b"mine")[0]) for _, t in rows)
