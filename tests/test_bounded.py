"""What keeps disk and passes small: moments in place of contexts, vectors of bags of words."""

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import attributes, conditional, learning
from tracewell.streaming import merging


def test_gradients_follow_from_moments():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=(50, 4))
    head = learning.Head(6, 4, 2)
    head.b += 0.3
    m = learning.Moments.unpacked(learning.Moments.part(x[:20], y[:20]) + learning.Moments.part(x[20:], y[20:]), 6, 4)
    assert np.allclose(head.gradient_of(m), head.gradient(x, y))
    scale = np.arange(1.0, 7)
    assert np.allclose(head.gradient_of(m.scaled(scale)), head.gradient(x / scale, y))


def test_moments_are_those_of_the_contexts(spark):
    events = [("h", i, i, i, "train" if i < 30 else "test", "EVENT_READ", "file", "process", i % 7, 10 + i % 4) for i in range(40)]
    placed = spark.createDataFrame(events, "host string, stream_pos long, event_id long, ts_us long, split string, action string, src_kind string, dst_kind string, info_src long, info_dst long")
    rng = np.random.default_rng(2)
    nodes = spark.createDataFrame([(n, rng.normal(size=64).tolist()) for n in [*range(7), *range(10, 13)]], "node_id long, embedding array<double>")
    actions = {"EVENT_READ": rng.normal(size=64)}
    rows = conditional.replayed(placed, nodes, actions).where("split = 'train'").collect()
    x, y = (np.array([r[c] for r in rows]) for c in "xy")
    m = conditional.moments(placed, nodes, actions)
    assert m.n == 30 and np.allclose(m.xx, x.T @ x) and np.allclose(m.xy, x.T @ y) and np.isclose(m.yy, (y * y).sum())
    near = conditional.packed_contexts(placed, nodes, actions)
    got = learning.matrix(near.toArrow().column("x").combine_chunks())
    assert got.shape == (30, 136) and np.allclose(np.sort(got, 0), np.sort(x, 0), atol=1e-6)


def test_contexts_with_shared_vectors_are_those_of_nodes_with_their_own(spark):
    events = [(f"h{i % 2}", i, i, i, "train", "EVENT_READ", "file", "process", i % 7, 10 + i % 4) for i in range(60)]
    placed = spark.createDataFrame(events, "host string, stream_pos long, event_id long, ts_us long, split string, action string, src_kind string, dst_kind string, info_src long, info_dst long")
    vectors = {b: [float(v) for v in np.random.default_rng(b).normal(size=64)] for b in range(3)}
    nodes = [*range(7), *range(10, 13)]
    own = spark.createDataFrame([(n, vectors[n % 3]) for n in nodes], "node_id long, embedding array<double>")
    shared = spark.createDataFrame([(n, n % 3) for n in nodes], "node_id long, bag long"), spark.createDataFrame(list(vectors.items()), "bag long, embedding array<double>")
    sent = conditional._known(placed, shared)
    assert sent.where("embedding IS NOT NULL").count() == 6 and sent.where("stream_pos = -1").count() == conditional._known(placed, own).count()
    actions = {"EVENT_READ": np.ones(64)}
    got, want = ({r.event_id: (r.x, r.y) for r in conditional.replayed(placed, n, actions).collect()} for n in (shared, own))
    assert len(got) == 60 and got == want


def test_equal_bags_have_one_vector(spark):
    words = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["a", "a", "new"]), (4, [])], "node_id long, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("<unk>", [-1.0, 1.0])], "token string, embedding array<double>")
    of, bags = learning.word_bags(words, vectors, "node_id")
    at = {r.node_id: r.bag for r in of.collect()}
    assert at[1] == at[2] != at[3] and bags.count() == 2
    got = {r.node_id: r.embedding for r in learning.mean_vectors(words, vectors, "node_id").orderBy(F.col("node_id")).collect()}
    assert set(got) == {1, 2, 3} and np.allclose(got[1], [0.5**0.5] * 2) and np.allclose(got[3], [0.5**0.5] * 2)


def test_a_change_takes_one_transform(monkeypatch):
    """A state is transformed once for each change, and the mean once more where it joins another."""
    taken, step, states, joined = [], merging.Merging().step(), {}, 0
    true = merging.Merging.signature
    monkeypatch.setattr(merging.Merging, "signature", lambda self, state: taken.append(1) or true(self, state))
    for i in range(300):
        joined += step(states, SimpleNamespace(host="h", stream_pos=i, event_id=i, action="EVENT_READ", src_kind="file", dst_kind="process", info_src=i % 50, info_dst=100 + i % 7))[-1]
    assert joined and len(taken) == 600 + joined


def test_nodes_of_one_file_are_cut_into_words_by_many_tasks(spark):
    columns = "node_id long, uuid string, kind string, path string, cmd string, dst_addr string, dst_port string"
    nodes = spark.createDataFrame([(i, f"U{i}", "file", f"/tmp/a{i}.txt", None, None, None) for i in range(100)], columns).coalesce(1)
    words = attributes.summaries(nodes)
    assert "hashpartitioning(node_id" in words._jdf.queryExecution().executedPlan().toString() and words.count() == 100
