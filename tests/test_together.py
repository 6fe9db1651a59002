"""Learning in tasks that go through the epochs together: each step of the method, against finite differences and a plain loop."""

import numpy as np
import pytest

from tracewell.operators import conditional, variants
from tracewell.operators.learning import Head


def loss_of(head, x, y, mse):
    p = head.predict(x)
    return head.distance(x, y).mean() + mse * ((p - y) ** 2).mean()


def test_a_step_goes_along_the_gradient_of_cosine_and_squared_error():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=(40, 4))
    for k in range(3):
        at, moved = Head(5, 4, 2), Head(5, 4, 2)
        assert variants.descended(moved, x, y, 1.0, 0.25, 0.0, 1e9) == pytest.approx(loss_of(at, x, y, 0.25))
        v, w = at.parameters[k], moved.parameters[k]
        for i in np.ndindex(v.shape):
            v[i] += 1e-6
            up = loss_of(at, x, y, 0.25)
            v[i] -= 2e-6
            slope = (up - loss_of(at, x, y, 0.25)) / 2e-6
            v[i] += 1e-6
            assert v[i] - w[i] == pytest.approx(slope, abs=1e-6)
    clipped, decayed = Head(5, 4, 2), Head(5, 4, 2)
    variants.descended(clipped, x, y, 1.0, 0.25, 0.0, 1e-3)
    assert np.linalg.norm(clipped.packed - Head(5, 4, 2).packed) == pytest.approx(1e-3)
    variants.descended(decayed, x, y, 1.0, 0.25, 0.5, 1e9)
    plain = Head(5, 4, 2)
    variants.descended(plain, x, y, 1.0, 0.25, 0.0, 1e9)
    assert np.allclose(plain.w1 - decayed.w1, 0.5 * Head(5, 4, 2).w1)


def test_the_loss_does_not_see_how_long_a_context_is(spark):
    """Rows are scaled each by itself: contexts times anything give the same losses."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 6)), rng.normal(size=(300, 3))
    losses = []
    for factor in (np.ones(300), np.exp(rng.normal(size=300))):
        data = spark.createDataFrame([((a * f).tolist(), b.tolist()) for a, b, f in zip(x, y, factor)], "x array<double>, y array<double>")
        losses.append(variants.fit_lowrank(data, epochs=4)[2])
    assert losses[0] == pytest.approx(losses[1]) and losses[0][-1] < losses[0][0]
    assert losses[0][0] == pytest.approx(loss_of(Head(6, 3), variants.row_scaled(x), y, 0.25), abs=0.1)
    with pytest.raises(ValueError):
        variants.fit_lowrank(data.limit(0))


def test_tasks_find_what_one_loop_finds(spark):
    rng = np.random.default_rng(6)
    x, y, case = rng.normal(size=(200, 6)), rng.normal(size=(200, 4)), rng.integers(0, 2, 200)
    data = spark.createDataFrame([(conditional.CASES[c], a.tolist(), b.tolist()) for a, b, c in zip(x, y, case)], "target_case string, x array<double>, y array<double>")
    heads, losses = conditional.fit_heads(data, rank=3, epochs=6)
    for i, c in enumerate(conditional.CASES):
        own, head = case == i, Head(6, 4, 3, 23 + i, "cosine")
        moments = [(np.zeros_like(v), np.zeros_like(v)) for v in head.parameters]
        for t in range(6):
            g = head.gradient(x[own], y[own])
            assert losses[t][c] == pytest.approx(g[0] / g[1], rel=1e-9)
            head.moved(g, moments, t + 1, 0.05)
        assert np.allclose(heads.by_case[c].packed, head.packed, atol=1e-9)
