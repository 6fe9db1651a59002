import numpy as np

from tracewell.llm import hash_index as h


def brute(rows, every=50, nearest=5):
    rows = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    out = {}
    for q, v in rows:
        if q % every == 0:
            got = sorted((-(w @ v) / np.sqrt((w @ w) * (v @ v)), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in got[:nearest]]
    return out


def test_every_code_within_the_radius_is_probed():
    rng = np.random.default_rng(1)
    code = h.learn(rng.normal(size=(500, 24)), bits=72)
    assert code.bits == 72 and code.substrings == 4 and code.words == 2
    x = code.codes(rng.normal(size=(400, 24)))
    values = code.values(x)
    for radius in (3, 17, 30):
        limits = code.limits(radius)
        for q in range(40):
            probed = (np.bitwise_count(values ^ values[q]) <= limits).any(axis=1)
            assert probed[np.bitwise_count(x ^ x[q]).sum(axis=1) <= radius].all()


def test_cells_hold_every_row_and_queries_reach_them():
    rng = np.random.default_rng(3)
    code = h.learn(rng.normal(size=(500, 16)), bits=32)
    x = code.codes(rng.normal(size=(700, 16)))
    x[:300] = x[0]
    values = code.values(x)
    j = np.tile(np.arange(2), len(x))
    cells, counts = np.unique(np.stack((j, values.ravel()), axis=1), axis=0, return_counts=True)
    placed = h.Cells(code, cells[:, 0], cells[:, 1], counts, 50)
    parts = placed.index_parts(values, np.arange(len(x)))
    assert np.bincount(parts.ravel()).max() <= 110
    for q in (0, 350, 400):
        reached = set(placed.query_parts(values[q], 6).tolist())
        near = (np.bitwise_count(values ^ values[q]) <= code.limits(6))
        assert set(parts[near].tolist()) <= reached


def test_exact_with_a_full_radius_and_salted_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[7].tolist()) for i in range(300, 420)] + [(500, x[7].tolist()), (500, x[7].tolist()), (550, (2 * x[9]).tolist())]
    odd = [(600, None), (650, [0.0] * 8), (700, [1.0] * 7 + [None]), (701, [float("nan")] * 8), (702, [1.0] * 9), (None, x[1].tolist()), (750, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, "k") for r in rows + odd], "vec_id long, embedding array<double>, no string")
    monkeypatch.setattr(h, "FIRST_RADII", (1.0, 1.0))
    for part_rows in (h.PART_ROWS, 40):
        got = {}
        for r in h.search(df, part_rows=part_rows).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        want = brute(rows)
        assert set(got) == set(want)
        for q, near in want.items():
            mine = [got[q][k] for k in sorted(got[q])]
            assert np.allclose([s for _, s in mine], [s for _, s in near]) and [i for i, _ in mine] == [i for i, _ in near], q
    assert h.search(df.limit(0)).count() == 0
    assert h.search(df.where("vec_id = 0")).count() == 0


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    passes = []
    got = {(r.query_id, r.vec_id) for r in h.search(table, probed=passes).collect()}
    n = table.count()
    print([(q, r / q, p / q / n, c / q / n) for q, r, p, c in passes])
    assert len(passes) == 3 and passes[0][2] / passes[0][0] / n < 0.2  # the first pass probes few codes
    hits = [(q, i) in got for q, near in want.items() for i, _ in near]
    assert np.mean(hits) >= 0.9


def test_every_query_has_all_its_ranks(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=16)
    # outliers are asked for, and lie opposite to a tight cluster
    clustered = [(i, (-middle + rng.normal(size=16) if i % 50 == 0 else middle + 0.01 * rng.normal(size=16)).tolist()) for i in range(301)]
    small = [[(50 * i, rng.normal(size=64).tolist()) for i in range(n)] for n in (2, 4, 10)]
    for rows in (clustered, *small):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        for part_rows in (h.PART_ROWS, 40):
            got = {}
            for r in h.search(df, part_rows=part_rows).collect():
                got.setdefault(r.query_id, []).append(r.rank)
            assert {q: sorted(k) for q, k in got.items()} == {i: list(range(1, min(5, len(rows) - 1) + 1)) for i, _ in rows if i % 50 == 0}
    exact = {(r.query_id, r.rank, r.vec_id) for r in h.search(spark.createDataFrame(small[1], "vec_id long, embedding array<double>")).collect()}
    assert exact == {(q, k, i) for q, near in brute(small[1]).items() for k, (i, _) in enumerate(near, 1)}


def test_components_of_any_size(spark):
    """Huge, tiny and denormal components count like any: cosines against whole fractions."""
    from fractions import Fraction
    from math import isqrt

    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * [1.0, 1e301, 1e200, 1e-200][i % 4]).tolist()) for i in range(40)]
    rows += [(100, [1e301, 0.5, *[0.0] * 6]), (150, [1e200, 1e199, *[0.0] * 5, 1e180]), (200, [1e-200] * 8), (250, [0.0, 5e-324, *[0.0] * 6]), (251, [1.7e308] * 8)]
    whole = {i: [Fraction(x) for x in v] for i, v in rows}

    def cosine(a, b):
        dot, square = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) * sum(y * y for y in b)
        share = dot * dot / square
        return (1 if dot > 0 else -1) * float(Fraction(isqrt(int(share * 10**40)), 10**20))

    got = {}
    for r in h.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100, 150, 200, 250}
    hits = 0
    for q, found in got.items():
        exact = {i: cosine(whole[q], v) for i, v in whole.items() if i != q}
        best = sorted(exact, key=lambda i: (-exact[i], i))[:5]
        assert [k for k, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(s - exact[i]) < 1e-9 for _, i, s in found)
        hits += sum(i in best for _, i, _ in found)
    assert hits >= 0.9 * 25


def test_no_unchecked_broadcast(spark):
    """Queries that are short of their ranks widen their radius; nothing is crossed with all vectors."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=16)
    rows = [(i, (-middle + rng.normal(size=16) if i % 50 == 0 else middle + 0.01 * rng.normal(size=16)).tolist()) for i in range(301)]
    found = h.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan and "strategy=broadcast" not in plan
    assert found.count() == 7 * 5
