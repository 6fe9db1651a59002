"""Integer product codes against k-means in plain Python numbers."""

import hashlib
import math

import numpy as np
import pytest

from tracewell.llm import product_codes, queries


def brute(rows, parts=8, k=16, rounds=6):
    """rows of (vec_id, vector, label) -> rows of the digest."""
    rows = [(i, [math.floor(4096 * x) if abs(x) < 1e300 else 4096 * int(x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not rows:
        return []
    d = len(rows[0][1]) // parts
    cut = [[v[p * d : p * d + d] for p in range(parts)] for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][1]))[:k]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def gap(x, c):
        return sum((a - b) ** 2 for a, b in zip(x, c))

    def nearest():
        return [[min(range(len(books[p])), key=lambda e: (gap(row[p], books[p][e]), e)) for p in range(parts)] for row in cut]

    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut[r][p] for r in range(len(rows)) if codes[r][p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    codes = nearest()
    errors = [min(sum(gap(cut[r][p], books[p][codes[r][p]]) for p in range(parts)), product_codes.LARGEST) for r in range(len(rows))]
    by_label = {}
    for (_, _, y), e in zip(rows, errors):
        by_label[y] = by_label.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e in c), e, min(by_label[y], product_codes.LARGEST), sha) for (i, _, y), c, e in zip(rows, codes, errors)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert ordered(queries.QUERIES["op12_product_codes"](spark, sf).collect()) == ordered(brute(rows))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_edges(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=16)], int(i) % 3 if i % 5 else None) for i in range(60)]
    same = rows[7][1]
    rows += [(100 + i, same, 1) for i in range(30)]  # a group of copies
    rows += [(7, same, 2), (7, rows[3][1], 2), (None, rows[4][1], 1)]  # repeated and null ids
    rows += [(-5, None, 1), (-4, [None] + [1.0] * 15, 1), (-3, [float("nan")] * 16, 1), (-2, [float("inf")] + [0.0] * 15, None), (-1, [0.0] * 16, 0)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    assert ordered(product_codes.digest(frame).collect()) == ordered(brute(rows))


@pytest.mark.parametrize("scale", [1e6, 1e19, 1e301, 1e-200])
def test_sizes(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=8) * scale], 0) for i in range(25)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert ordered(product_codes.digest(frame).collect()) == ordered(brute(rows))


def test_few_and_none(spark):
    ddl = "vec_id long, embedding array<double>, label int, code string"
    assert product_codes.digest(spark.createDataFrame([], ddl)).collect() == []
    assert product_codes.digest(spark.createDataFrame([(1, None, 2, "x")], ddl)).collect() == []
    rows = [(3, [0.5] * 8, None), (1, [0.25] * 8, 4)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], ddl)
    assert ordered(product_codes.digest(frame).collect()) == ordered(brute(rows))


def test_net_displacement_rescans_less(spark):
    """The bounds leave few parts to compare, and fewer than bounds that add up the steps' norms."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    vectors = np.floor(4096 * (centres[rng.integers(0, 20, 3000)] + 0.2 * rng.normal(size=(3000, 16)))).astype(np.int64)
    x, books = vectors[:, :2], [[vectors[:16, :2]]]
    state, total, everything = None, 0, 0
    summed_state, summed_total = None, 0
    for _ in range(6):
        net = product_codes.History(books, False)
        state, n = net.assigned(0, x, state)
        summed = product_codes.History(books, False)
        steps = np.stack([product_codes._norm(b[0] - a[0]) for a, b in zip(books, books[1:])] or [np.zeros(16)])
        after = np.concatenate([np.cumsum(steps[::-1], axis=0)[::-1], np.zeros((1, 16))])[: len(books)] if len(books) > 1 else np.zeros((1, 16))
        summed.moved = [after]
        summed.others_moved = [np.where(np.eye(16, dtype=bool), -np.inf, after[:, None, :]).max(axis=2)]
        summed_state, m = summed.assigned(0, x, summed_state)
        assert (state["entry"] == summed_state["entry"]).all()
        assert (net.moved[0] <= after + 1e-6).all()
        total, summed_total, everything = total + n, summed_total + m, everything + len(x)
        books.append([np.array([x[state["entry"] == e].sum(axis=0) // max(1, (state["entry"] == e).sum()) if (state["entry"] == e).any() else books[-1][0][e] for e in range(16)])])
    assert total <= summed_total and total < everything
