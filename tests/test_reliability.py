"""Perturbed twins of events, rarities and gates: by hand, against plain counts, and by finite differences."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import reliability
from tracewell.operators.reliability import COMPONENTS, Gate, Rarities, Reliability


def flow(spark, n=600, seed=5):
    """Two hosts: browsers receive from the network, shells write files; each source is regular in time."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        host, net = f"h{i % 2}", i % 4 < 2
        src = 10 + i % 2 if net else 20 + i % 2
        action, dst, kind = ("EVENT_SENDTO", 100 + int(rng.integers(3)), "netflow") if net else ("EVENT_WRITE", 200 + int(rng.integers(3)), "file")
        rows.append((host, i, "train" if i < n // 2 else "validation" if i < 3 * n // 4 else "test", i * 4_000_000, action, src, dst, "process", kind))
    return spark.createDataFrame(rows, "host string, event_id long, split string, ts_us long, action string, info_src long, info_dst long, src_kind string, dst_kind string")


def test_gap_buckets(spark):
    us = [None, 0, 1_999_999, 2_000_000, 3_999_999, 4_000_000, 1024_000_000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(us)], "i int, us long")
    assert [r.g for r in df.select("i", reliability.gap_bucket(F.col("us")).alias("g")).orderBy("i").collect()] == [-1, 0, 0, 1, 1, 2, 10]


def test_twins_differ_in_what_was_perturbed(spark):
    rows = reliability.with_gaps(flow(spark)).persist()
    own = {r.event_id: r for r in rows.collect()}
    found = reliability.twins(rows).collect()
    kinds = Counter(t.twin for t in found)
    assert kinds["time"] == len(own) and min(kinds["action"], kinds["object"]) > 0.95 * len(own)
    for t in found:
        e = own[t.event_id]
        changed = {c for c in ("action", "info_dst", "gap_us") if t[c] != e[c]}
        assert changed == {{"action": "action", "object": "info_dst", "time": "gap_us"}[t.twin]}
        assert (t.info_src, t.host, t.ts_us) == (e.info_src, e.host, e.ts_us)
        if t.twin == "time":
            assert t.gap_us - (e.gap_us or 0) in {2**k * 1_000_000 for k in range(6, 17)}
    again = {(t.event_id, t.twin, t.action, t.info_dst, t.gap_us) for t in reliability.twins(rows.repartition(7)).collect()}
    assert again == {(t.event_id, t.twin, t.action, t.info_dst, t.gap_us) for t in found}
    alone = rows.where("event_id = 3")
    assert [t.twin for t in reliability.twins(alone).collect()] == ["time"] and reliability.twins(rows.limit(0)).count() == 0


def test_rarities_against_plain_counts(spark):
    rows = reliability.with_gaps(flow(spark, 200)).persist()
    every = rows.collect()
    train = [r for r in every if r.split == "train"]
    got = {r.event_id: r for r in Rarities.fit(rows.where("split = 'train'")).of(rows).collect()}
    assert len(got) == len(every)
    for name, (given, what) in COMPONENTS.items():
        both, alone = Counter(tuple(r[c] for c in (*given, *what)) for r in train), Counter(tuple(r[c] for c in given) for r in train)
        distinct = len({tuple(r[c] for c in what) for r in train}) + 1
        for r in every:
            want = -math.log((both[tuple(r[c] for c in (*given, *what))] + 1) / (alone[tuple(r[c] for c in given)] + distinct))
            assert got[r.event_id][f"c_{name}"] == pytest.approx(want)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(7)
    z, t = rng.gamma(1, size=(30, 4)), rng.gamma(2, size=(30, 4))
    gate = Gate.new(4, cost=0.3, decay=0.01)
    gate.weights += rng.normal(0, 0.3, gate.weights.shape)
    g = gate.gradient(z, t)
    assert g[1] == 30
    for i, j in ((0, 0), (1, 4), (2, 5), (3, 1)):
        losses = []
        for step in (1e-5, -1e-5):
            w = gate.weights.copy()
            w[i, j] += step
            losses.append(Gate(w, gate.floor, gate.margin, gate.cost, gate.decay).gradient(z, t)[0])
        assert g[2:].reshape(gate.weights.shape)[i, j] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_a_component_that_sees_nothing_closes(spark):
    events = flow(spark, 1200)
    blind = COMPONENTS | {"blind": (["host"], ["src_kind"])}
    model = Reliability.fit(events, blind, rounds=60, rate=0.2)
    # destinations of one kind are equally common here, so many swaps of them can't be told from events and keep their loss
    assert model.losses[-1] < model.losses[0] and min(model.losses) == pytest.approx(model.losses[-1], rel=0.02)
    test = reliability.with_gaps(events).where("split = 'test'").persist()
    summary = {r.component: r for r in model.summary(test).collect()}
    assert set(summary) == set(blind) and all(0.02 <= r.gate <= 1 for r in summary.values())
    every = model.scores(reliability.twins(test)).collect()
    gates = np.mean([r.gates for r in every], axis=0)
    place = {n: i for i, n in enumerate(blind)}
    assert gates[place["blind"]] == gates.min() and gates[place["gap"]] > 2 * gates[place["blind"]]
    normal = {r.event_id: r for r in model.scores(test).collect()}
    assert len(normal) == test.count() and all(r.score == pytest.approx(sum(r.parts)) for r in normal.values())
    by_twin = {}
    for r in every:
        by_twin.setdefault(r.twin, []).append((r.score > normal[r.event_id].score, r.top))
    assert np.mean([up for up, _ in by_twin["time"]]) > 0.95 and np.mean([up for up, _ in by_twin["action"]]) > 0.4
    assert Counter(top for _, top in by_twin["time"]).most_common(1)[0][0] == "gap"


def test_no_events_to_learn_on(spark):
    events = flow(spark, 40).where("split = 'train'")
    model = Reliability.fit(events)
    with pytest.raises(ValueError):
        Reliability.fit(events, floor=0.3)
    assert model.losses == [] and model.scores(reliability.with_gaps(events)).count() == 20


def test_packed_pairs_have_the_gradient_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    z, t = rng.gamma(1, size=(50, 4)), rng.gamma(2, size=(50, 4))
    gate = Gate.new(4)
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(z, t)], "z array<double>, t array<double>")
    monkeypatch.setattr(reliability, "PACKED", 16)
    packed = reliability.packed_pairs(pairs.coalesce(1)).persist()
    assert packed.count() == 4
    assert np.allclose(reliability.pair_gradients(packed, gate), gate.gradient(z, t))


def test_tables_beyond_few_rows_are_joined_alike(spark, monkeypatch):
    rows = reliability.with_gaps(flow(spark, 400)).persist()
    want = Reliability.fit(rows, rounds=3)
    monkeypatch.setattr(reliability, "FEW", 1)
    got = Reliability.fit(rows, rounds=3)
    assert got.usual == want.usual and np.allclose(got.gate.weights, want.gate.weights) and np.allclose(got.losses, want.losses)
