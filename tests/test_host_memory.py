"""A host's states and vectors in memory are bounded, and contexts don't change by that."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from test_blocks import flow

from tracewell.operators import conditional
from tracewell.sources.mapping import ACTIONS
from tracewell.streaming import blocks


@pytest.fixture
def stream():
    rows = flow(3000, 400).assign(split="train")
    nodes = np.unique(rows[["info_src", "info_dst"]].to_numpy())[:-5]  # the last are unknown
    bags = nodes // 1000 % 90 + 7
    vectors = np.random.default_rng(8).normal(size=(97, 64))
    actions = dict(zip(ACTIONS, np.random.default_rng(9).normal(size=(10, 64))))
    return pa.RecordBatch.from_pandas(rows[["host", *conditional._EVENT]], preserve_index=False), nodes, bags, vectors, actions


def test_contexts_of_states_in_a_file_are_those_in_memory(stream, monkeypatch):
    rows, nodes, bags, vectors, actions = stream
    plain = conditional.HostStates(actions)
    plain.places(nodes.tolist())
    plain.own[: len(nodes)] = vectors[bags]
    ends = [plain.places(rows.column(c).to_pylist()) for c in ("info_src", "info_dst")]
    want = plain.step(plain.block(*ends, rows))
    for small in (False, True):
        if small:  # nearly all rows are in the files
            monkeypatch.setattr(blocks.Rows.__init__, "__defaults__", (64, 11))
            monkeypatch.setattr(blocks.Places.__init__, "__defaults__", (20,))
            monkeypatch.setattr(conditional, "VECTORS", 13)
        memory = conditional.HostMemory(actions, None, None)
        for part in np.array_split(np.unique(bags)[::-1], 3):
            memory.share(part, vectors[part])
        for part in np.array_split(np.arange(len(nodes)), 4):
            memory.know(nodes[part], bags[part])
        got = [memory.step(rows.slice(i, 500)) for i in range(0, 3000, 500)]
        for k in range(3):
            assert np.array_equal(np.concatenate([g[k] for g in got]), want[k])
        assert len(memory.vectors.held) <= (13 if small else 2 * 97) and len(memory.held.held) <= (11 if small else 800)
        assert (memory.held.file is not None) == (memory.vectors.file is not None) == small


def test_nodes_cost_no_vectors_of_their_own(stream):
    """A hundred thousand nodes with one vector hold one row of it."""
    memory = conditional.HostMemory(stream[-1], None, None)
    memory.share(np.array([5]), np.ones((1, 64)))
    memory.know(np.arange(100_000), np.full(100_000, 5))
    assert len(memory.vectors.held) == 1 and len(memory.held.held) == 0 and memory.vector_of.nbytes <= 16 * 100_000
    assert set(memory.vector_of[:100_000]) == {0}


def test_scorers_and_views_send_a_shared_vector_once(spark):
    """Nodes with the same words have a number of their vector, not a vector each."""
    from tracewell.operators import views

    events = [("h", i, i, i, "train", "EVENT_READ", "file", "process", i % 40, 100 + i % 4) for i in range(120)]
    placed = spark.createDataFrame(events, "host string, stream_pos long, event_id long, ts_us long, split string, action string, src_kind string, dst_kind string, info_src long, info_dst long")
    words = spark.createDataFrame([(n, ["a", "b"] if n < 100 else ["c"]) for n in [*range(40), *range(100, 104)]], "node_id long, tokens array<string>")
    scorer = conditional.Scorer.fit(placed, words, epochs=1)
    for made in (scorer, views.View.fit(placed, words, "v")):
        of, bags = made.node_vectors
        assert of.count() == 44 and bags.count() == 2
        assert conditional._known(placed, made.node_vectors).where("embedding IS NOT NULL").count() == 2
    assert scorer.own_vectors.count() == 44 and scorer.scores(placed).count() == 120
