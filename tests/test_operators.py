import math
import random

import numpy as np
import pytest

from tracewell.operators import flow, learning
from tracewell.operators.quantiles import quantile_higher


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.999, 1.0])
def test_quantile_higher_is_exact(spark, q):
    rnd = random.Random(5)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(3000)] + [("b", float(rnd.randint(0, 3))) for _ in range(500)] + [(None, 2.0), (None, 1.0), ("c", 7.0), ("d", None)]
    got = {r.k: (r.n, r.x, r.vmax) for r in quantile_higher(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", q, "x").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: (len(v), sorted(v)[math.ceil(q * (len(v) - 1))], max(v)) for k, v in groups.items()}


def test_mean_cov_takes_every_dimension(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    x = np.array([r.embedding for r in table.collect()], float)
    got = sorted(learning.mean_cov(table).collect())
    assert [r.i for r in got] == list(range(x.shape[1]))
    assert np.allclose([r.mean for r in got], x.mean(axis=0)) and np.allclose([r.scale for r in got], x.std(axis=0))
    assert np.allclose([r.inverse for r in got], np.linalg.pinv(np.cov(x.T, bias=True) + 1e-3 * np.eye(x.shape[1])))
    assert learning.mean_cov(table.limit(0)).count() == 0


def test_leave_one_out_is_the_fit_of_the_other_hosts(spark):
    """Every host's model against gradient descent in plain numpy on the others' rows."""
    rng = np.random.default_rng(8)
    rows = []
    for h in range(5):
        for k in range(40):
            a, b = rng.normal(size=2)
            rows.append((f"h{h}", k, float(a), float(3 + 2 * b), float(rng.random() < 1 / (1 + np.exp(-(a - 0.5 * b - 0.2 * h))))))
    made = spark.createDataFrame(rows, "host string, node_id long, a double, b double, label double").repartition(3)
    got = {(r.host, r.node_id): r.probability for r in learning.leave_one_out(made, ["a", "b"]).collect()}
    x = np.array([r[2:4] for r in rows])
    x = np.c_[(x - x.mean(0)) / x.std(0), np.ones(len(x))]
    y, host = np.array([r[4] for r in rows]), np.array([r[0] for r in rows])
    share = np.array([y[host == h].mean() for h in host])
    w = np.where(y > 0, 1 - share, share)
    for h in sorted(set(host)):
        beta, rest = np.zeros(3), host != h
        for _ in range(20000):
            beta += 0.02 * x[rest].T @ (w[rest] * (y[rest] - 1 / (1 + np.exp(-x[rest] @ beta))))
        want = 1 / (1 + np.exp(-x[~rest] @ beta))
        assert np.allclose([got[h, k] for k in range(40)], want, atol=1e-5)
    assert learning.leave_one_out(made.limit(0), ["a", "b"]).count() == 0


@pytest.mark.parametrize("loss", ["squared", "cosine"])
def test_gradient_of_a_head(loss):
    rng = np.random.default_rng(9)
    head, x, y = learning.Head(7, 5, 3, loss=loss), rng.normal(size=(11, 7)), rng.normal(size=(11, 5))
    head.b += rng.normal(size=5)
    g, at = head.gradient(x, y), 2
    assert g[1] == 11 and head.gradient_size == len(g)
    for p in head.parameters:
        for i in np.ndindex(p.shape):
            was = p[i]
            p[i] = was + 1e-6
            up = head.gradient(x, y)[0]
            p[i] = was - 1e-6
            down = head.gradient(x, y)[0]
            p[i] = was
            assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-5, abs=1e-6)
            at += 1


def test_endpoint_signatures_fall_back(spark):
    rows = [(1, "10.0.0.1", "22", "10.9.9.9", "1"), (2, "10.0.0.2", None, None, None), (3, None, None, "10.9.9.9", "70"), (4, " ", "5", "10.9.9.8", None), (5, None, "5", "", "6")]
    nodes = spark.createDataFrame(rows, "node_id long, dst_addr string, dst_port string, src_addr string, src_port string")
    got = lambda df: [r[0] for r in df.orderBy("node_id").select(flow.endpoint_signature(df.columns)).collect()]
    assert got(nodes) == ["10.0.0.1:22", "10.0.0.2:", "10.9.9.9:70", "10.9.9.8:", "node:5"]
    assert got(nodes.drop("src_addr", "src_port")) == ["10.0.0.1:22", "10.0.0.2:", "node:3", "node:4", "node:5"]
    assert got(nodes.select("node_id")) == [f"node:{i}" for i in range(1, 6)]
