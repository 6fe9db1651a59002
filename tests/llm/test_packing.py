import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tracewell.llm import bpe, packing


def test_hilbert_neighbours_are_adjacent():
    n = 8
    grid = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(n**3))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pieces_hold_every_id_once(spark):
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {i: " ".join(f"word{(i * j) % 97} the" for j in range(i * 40)) for i in range(30)} | {50: None, 51: "", 52: "<|endoftext|> hi"}
    rows = [(i, t, 7) for i, t in texts.items()] + [(None, "no id", 1), (3, texts[3], 1), (3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = packing.packed(df, with_ids=True).collect()
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    sequences = defaultdict(list)
    total = defaultdict(int)
    for r in got:
        ids = next(x for x in want[r.doc_id] if len(x) == r.doc_tokens)[r.start : r.start + r.length]
        assert list(r.ids) == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id] += r.length
    assert dict(total) == {i: sum(map(len, x)) for i, x in want.items()}
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 2048
    assert packing.packed(df.limit(0)).count() == 0


def test_sequences_follow_the_curve_and_stretches_are_even(spark):
    rnd = np.random.default_rng(4)
    words = ["alpha", "beta", "naïve", "über", "x1", "<tag>", "99", "qq\n"]
    texts = [" ".join(rnd.choice(words[: 2 + i % 6], rnd.integers(1, 400))) for i in range(300)] + ["the same text " * 40] * 300 + ["long " * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(packing.packed(df).collect(), key=lambda r: (r.sequence_id, r.offset))
    place = packing.curve_keys([t.encode() for t in texts])
    met = [int(place[r.doc_id]) for r in got]
    assert met == sorted(met)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.sequence_id >> 33] += r.length
    assert len(sizes) == 4 and max(sizes[k] for k in sizes) < 2 * 60_000
