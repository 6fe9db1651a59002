import hashlib
import random

import numpy as np

from tracewell.llm import substring_dedup, suffixes


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if i is None else i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def made(seed, n):
    rnd = random.Random(seed)
    vocab = ["tion", "the ", "é", "an ", "ing ", "of ", "ß", "ha", "x\n"]
    say = lambda k: "".join(rnd.choice(vocab) for _ in range(k))
    shared = [say(60) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join(rnd.choice([say(rnd.randint(1, 50)), rnd.choice(shared), rnd.choice(shared)[3:55]]) for _ in range(rnd.randint(0, 6)))
        rows.append((i, t))
    rows += [(n + 1, rows[2][1]), (n + 2, None), (n + 3, "a" * 49), (n + 4, "a" * 200), (n + 5, "a" * 180 + "b"), (n + 6, "ab" * 300), (n + 7, "ba" * 200)]
    return rows


def test_against_brute_force(spark):
    rows = made(1, 60)
    rows += [(None, rows[2][1]), (5, rows[5][1]), (5, rows[8][1]), (9, rows[9][1])]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, `__part` string, n_bytes int")
    for chunk, shard, hot in ((substring_dedup.CHUNK_BYTES, substring_dedup.SHARD_BYTES, substring_dedup.HOT_RUNS), (3000, 300, 20)):
        got = substring_dedup.deduplicated(df, chunk, shard, hot)
        assert got.columns == ["doc_id", "text", "__part", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        assert sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in substring_dedup.digest(got).collect()) == brute(rows)
    assert substring_dedup.deduplicated(df.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_chunks")]


def test_one_phrase_in_ever_new_surroundings_and_long_texts(spark):
    rnd = random.Random(6)
    say = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    phrase = say(60)
    rows = [(i, say(70) + phrase + say(70)) for i in range(150)] + [(200, say(40_000) + phrase + say(9000)), (201, say(30) * 900), (202, rows_text := say(25_000)), (203, "x" + rows_text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (substring_dedup.HOT_RUNS, 10):
        got = substring_dedup.deduplicated(df, 20_000, 4000, hot)
        assert sorted(map(tuple, substring_dedup.digest(got).collect())) == brute(rows)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for n, k in ((1, 2), (400, 2), (3000, 3), (500, 1)):
        text = rng.integers(0, k, n).astype(np.uint8)
        raw = text.tobytes()
        order = suffixes.suffix_array(text, 64)
        cut = [raw[i : i + 64] for i in order]
        assert cut == sorted(cut) and sorted(order) == list(range(n))
        lcp = suffixes.common_prefixes(text, order, 50, lane=7)
        for a, b, h in zip(cut, cut[1:], lcp[1:]):
            same = next((i for i in range(min(50, len(a), len(b))) if a[i] != b[i]), min(50, len(a), len(b)))
            assert same == h


def test_pieces_that_share_more_than_the_array_is_sorted_by():
    rnd = random.Random(3)
    pieces, owner = [], []
    for _ in range(400):
        head = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(64, 76)))
        for c in rnd.sample([b"x", b"y", b"a", b"b"], 2):
            pieces.append(head + c + bytes(rnd.choice(b"ab") for _ in range(rnd.randint(20, 60))))
            owner.append(len(owner))
    owner = np.array(rnd.sample(owner, len(owner)), np.int64)
    least = {}
    for p, o in zip(pieces, owner.tolist()):
        for i in range(len(p) - 49):
            least[p[i : i + 50]] = min(least.get(p[i : i + 50], o), o)
    want = [[least[p[i : i + 50]] for i in range(len(p) - 49)] for p in pieces]
    for shard in (1 << 20, 5000):
        assert [x.tolist() for x in suffixes.least_owner(pieces, owner, 50, shard)] == want
