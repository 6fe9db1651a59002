import math
import zlib

import numpy as np

from tracewell.llm import quality_gam as q

SF = "/root/testdata/sf0.01"


def plain_features(t):
    """The features in plain loops over bytes."""
    words, cur = [], b""
    for c in t + b" ":
        if c in b" \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = b""
        else:
            cur += bytes([c])
    count = lambda chars: sum(c in chars for c in t)
    n, k = max(len(t), 1), max(len(words), 1)
    capitals, small = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"abcdefghijklmnopqrstuvwxyz")
    lines = [x for x in t.split(b"\n") if x.strip()]
    times = {x: lines.count(x) for x in set(lines)}
    freq = [t.count(bytes([c])) / n for c in set(t)]
    pairs = [(words[i], words[i + 1]) for i in range(len(words) - 1)]
    kinds = {}
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    return [
        math.log1p(len(t)), math.log1p(len(words)), sum(len(x) for x in words) / k, math.log1p(max([len(x) for x in words], default=0)), count(b"#*$%&|<>~^=_{}[]\\@+") / n,
        count(b"0123456789") / n, capitals / max(capitals + small, 1), count(b".,;:") / k, count(b"!?") / k, count(b"\n") / k, 1 - len(times) / max(len(lines), 1), len(kinds) / k,
        max(kinds.values(), default=0) / k, 1 - len(set(pairs)) / len(pairs) if pairs else 0.0, sum(c > 127 for c in t) / n, sum(len(x) <= 3 for x in words) / k, -sum(p * math.log2(p) for p in freq),
        max([c * len(x) for x, c in times.items() if c > 1], default=0) / n, float(len(set(t))), count(b"|") / k,
    ]


def plain_score(m, x):
    bin_of = lambda cuts, v: sum(1 for c in cuts if c <= v)
    z = m.base
    for cuts, table, v in zip(m.cuts, m.tables, x):
        z += table[bin_of(cuts, v)]
    for a, b, table in m.pairs:
        z += table[bin_of(m.pair_cuts[a], x[a]), bin_of(m.pair_cuts[b], x[b])]
    return 1 / (1 + math.exp(-z))


def test_tables_find_main_effects_and_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) | (x[:, 2] > 1.5)).astype(float)
    m = q.fit(x[:5000], y[:5000])
    assert ((m.score(x[5000:]) > 0.5) == y[5000:]).mean() > 0.93
    # the score is the sum of the tables' bins
    z = m.base + sum(t[int((c <= x[7, j]).sum())] for j, (c, t) in enumerate(zip(m.cuts, m.tables)))
    z += sum(t[int((m.pair_cuts[a] <= x[7, a]).sum()), int((m.pair_cuts[b] <= x[7, b]).sum())] for a, b, t in m.pairs)
    assert abs(m.score(x[7:8])[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in q.judged(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    pairs = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine text here.", 9.0), (1, "fine text here.", 1.0), (2, None, 1.0), (None, "", 1.0), (4, "x" * 100000, 1.0)], "doc_id long, text string, gam_score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(q.judged(docs, labels).collect()) == 5
    assert len(q.judged(docs, labels.limit(0)).collect()) == 5
    assert q.judged(docs.limit(0), labels).collect() == []
    assert q.kept(docs, labels).columns == docs.columns
