"""Blocks of rows give what the steps give row by row, over nodes that are met again, loops, alerts, and states beyond what is held in memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.sources.mapping import ACTIONS
from tracewell.streaming import blocks, fold, folds

BY_HOST = [n for n, f in folds.EVENT_FOLDS.items() if f.block]
BY_NODE = [n for n, f in folds.NODE_FOLDS.items() if f.block]


def flow(n=4000, nodes=150, seed=5):
    rng = np.random.default_rng(seed)
    kinds = np.array(["process", "file", "netflow"])
    src, dst = rng.integers(0, nodes, n), rng.integers(0, nodes, n) ** 2 // nodes
    days = np.sort(rng.integers(0, 900, n))
    return pd.DataFrame({
        "host": "h", "stream_pos": np.arange(n), "event_id": np.arange(n) * 3, "action": np.array(ACTIONS)[rng.integers(0, 10, n)], "src_kind": kinds[src % 3], "dst_kind": kinds[dst % 3],
        "info_src": src * 1000, "info_dst": dst * 1000, "score": rng.integers(0, 100000, n).astype(float), "ts_us": 10**15 + days * 86_400_000_000,
    })


def by_step(f, rows):
    states, out, at = {}, [], None
    for row in rows.itertuples(index=False):
        key = tuple(getattr(row, k) for k in f.key)
        if key != at:
            at, states = key, {}
        out.append(f.step(states, row))
    return out


def by_block(f, rows, size):
    taken = f.block()
    parts = [pd.DataFrame(taken(rows.iloc[i : i + size])) for i in range(0, len(rows), size)]
    return list(pd.concat(parts).astype(object).itertuples(index=False, name=None))


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            if y is None:
                assert x is None or x is pd.NA
            elif isinstance(y, float):
                assert abs(x - y) <= 2e-9 * max(1.0, abs(y))
            else:
                assert x == y


@pytest.mark.parametrize("name", BY_HOST)
@pytest.mark.parametrize("size", [1, 700])
def test_blocks_of_a_host_are_its_steps(name, size, monkeypatch):
    monkeypatch.setattr(folds, "P", folds.Parameters(most_states=40, protected=60, most_risks=30))
    f, rows = folds.EVENT_FOLDS[name], flow()
    if size == 700:
        monkeypatch.setattr(blocks.Rows.__init__, "__defaults__", (folds.D, 37))  # most rows are in the file
        monkeypatch.setattr(blocks.Places.__init__, "__defaults__", (20,))
    same(by_block(f, rows if size > 1 else rows[:1500], size), by_step(f, rows if size > 1 else rows[:1500]))


@pytest.mark.parametrize("name", BY_NODE)
def test_blocks_of_nodes_are_their_steps(name):
    rows = flow(3000, 40).rename(columns={"info_src": "node_id", "src_kind": "kind", "dst_kind": "peer_kind"})
    rows = pd.concat([rows, rows[:500].assign(host="i")]).sort_values(["host", "node_id", "stream_pos"])
    for size in (100, 900):
        same(by_block(folds.NODE_FOLDS[name], rows, size), by_step(folds.NODE_FOLDS[name], rows))


def test_hosts_have_tasks_of_their_own(spark):
    def made():
        from pyspark import TaskContext

        return lambda rows: {"host": rows["host"], "task": TaskContext.get().partitionId()}

    rows = pd.concat([flow(300).assign(host=f"h{i}") for i in range(4)])
    task = fold.Fold(("host",), ("stream_pos",), ("event_id",), "host string, task int", None, made)
    got = fold.folded(spark.createDataFrame(rows), task).distinct().groupBy("task").agg(F.count("*").alias("n")).collect()
    assert len(got) == 4 and {r.n for r in got} == {1}
