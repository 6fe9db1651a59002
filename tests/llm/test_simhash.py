import random

import numpy as np
import xxhash

from tracewell.llm import simhash


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, budget=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(ids)):
        members = [ids[j] for j in range(len(ids)) if find(j) == find(i) and ids[j] is not None]
        out[i] = min(members, default=None)
    return out


def test_fingerprints_and_components(spark):
    rnd = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "DELTA", "épsilon", "zeta", "eta", "theta"]
    texts = [None, "", " \n\t", "one", "one two", "one two three"] + [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 400))) for _ in range(30)]
    for t in list(texts[6:16]):
        words = t.split(" ")
        words[rnd.randrange(len(words))] = "x"
        texts += [" ".join(words), t, t + "\x0b", t + " end"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[8], "n"), (3, "one", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.digest(simhash.near_duplicates(df)).collect()
    fps = [brute_fp(r[1]) for r in rows]
    want = brute_components([r[0] for r in rows], fps)
    assert sorted(((r[0] if r[0] is not None else -1), f"{fps[i]:016x}", want[i]) for i, r in enumerate(rows)) == sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got)


def test_trie_matches_all_pairs_in_dense_and_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [base]
    for _ in range(8):
        near.append(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)))
    fps = np.unique(np.concatenate([*near, base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    label = simhash.trie_components(np.zeros(len(fps)), fps, most=64)
    want = brute_components(list(range(len(fps))), [int(x) for x in fps])
    assert [want[i] for i in range(len(fps))] == list(label)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    monkeypatch.setattr(simhash, "LARGE_ROUTE", 20)
    monkeypatch.setattr(simhash, "ROUTE_KEYS", 100)
    monkeypatch.setattr(simhash, "SPLIT_BITS", 11)
    found = {r.node: r.root for r in simhash.components(simhash.link_forest(df)).collect()}
    signed = fps.view(np.int64)
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(found.get(int(x), int(x)), set()).add(want[i])
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want.values()))


def test_routes_keep_every_link(spark):
    """Pairs at most two bits apart, at every place of the two bits, share a route at every width."""
    fps = [0x0123456789ABCDEF ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    df = spark.createDataFrame([(0x0123456789ABCDEF,), *((x - (1 << 64) if x >> 63 else x,) for x in fps)], "fp long")
    for bits in (0, 5, 21):
        rows = simhash._routes(df, bits).collect()
        mine = {r.route for r in rows if r.fp == 0x0123456789ABCDEF}
        routes = {}
        for r in rows:
            routes.setdefault(r.fp, set()).add(r.route)
        assert all(mine & x for x in routes.values())


def test_keep_one_and_empty(spark):
    rows = [(5, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (None, "a b c d", "z"), (7, "other words here", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r.doc_id or -1) for r in simhash.keep_one(df).collect()) == [-1, 2, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_decides_for_rows(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(50)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = [say(300) for _ in range(12)] + [say(30_000)]
    rows = [(i % 7, t, i) for i, t in enumerate(base)] + [(i % 5, t + " x", 100 + i) for i, t in enumerate(base)] + [(2, base[0], 200), (5, base[0], 201), (5, base[1], 202), (3, None, 203), (4, "", 204)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row0 long")
    fps = [brute_fp(r[1]) for r in rows]
    groups = brute_components(list(range(len(rows))), fps)
    want = {}
    for k, r in enumerate(rows):
        want[groups[k]] = min(want.get(groups[k], (99, None)), (r[0], r[1] or ""))
    got = simhash.keep_one(df).collect()
    assert len(got) == len(want) and sorted(r.doc_id for r in got) == sorted(x[0] for x in want.values())
    kept = {groups[next(k for k, x in enumerate(rows) if x[2] == r["__row0"])] for r in got}
    assert kept == set(want)
