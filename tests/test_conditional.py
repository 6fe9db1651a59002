"""The conditional scorer against a plain model that takes events one by one, and its stream against its batch."""

import glob
import os
import shutil
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.functions import policies
from tracewell.operators import attributes, conditional, online, thresholds
from tracewell.operators.flow import histories
from tracewell.operators.learning import Head
from tracewell.sources.audit import Audit
from tracewell.streaming.folds import LAMBDA, RHO, SCALE, TAUS

SF = "/root/testdata/sf0.001"


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n > 1e-8 else v


def plain(events, vectors, actions, score=None, gate=None):
    """events of (src, dst, action, src_kind, dst_kind) -> (context, target, case) of each, one at a time."""
    keep = np.exp(-1 / TAUS)
    state, seen, source, out = {}, {}, {}, []
    zero = np.zeros(64)
    for s, d, action, sk, dk in events:
        own = [vectors.get(n, zero) for n in (s, d)]
        active = [seen.get(n, 0) >= 1 if k == "process" else seen.get(n, 0) >= 2 or source.get(n, 0) >= 1 for n, k in ((s, sk), (d, dk))]
        held = [state.get(n, zero) if on else zero for n, on in zip((s, d), active)]
        repr_ = [(v + h) / 2 if on else v for v, h, on in zip(own, held, active)]
        z = (own[0] + actions[action] + own[1]) / 3
        x = np.concatenate([*repr_, [float(k == sk) for k in SCALE], [float(k == dk) for k in SCALE]])
        case = "event_semantic" if any(active) else "both_cold_action"
        y = z if any(active) else actions[action]
        out.append((x, y, case))
        q = 1.0 if gate is None else float(gate(np.array([score(x, y, case)]))[0])
        lam, rho = LAMBDA[action] * SCALE[sk], RHO[action] * SCALE[sk]
        if s != d:
            state[s] = keep * state.get(s, zero) + (1 - keep) * q * rho * z
            seen[d] = seen.get(d, 0) + 1
        state[d] = keep * state.get(d, zero) + (1 - keep) * q * unit(z + lam * held[0])
        seen[s] = seen.get(s, 0) + 1
        source[s] = source.get(s, 0) + 1
    return out


@pytest.fixture(scope="module")
def made(spark):
    """Events of one host of the given tables, loops among them, and made vectors."""
    a = Audit.of(spark, SF)
    placed = a.placed.where("host IN ('h1', 'h2') AND stream_pos < 400").cache()
    rng = np.random.default_rng(4)
    nodes = sorted({n for r in placed.select("info_src", "info_dst").distinct().collect() for n in r})
    vectors = {n: unit(rng.normal(size=64)) for n in nodes[:-3]}  # the last have none
    actions = {r[0]: unit(rng.normal(size=64)) for r in placed.select("action").distinct().orderBy("action").collect()}
    table = spark.createDataFrame([(int(n), v.tolist()) for n, v in vectors.items()], "node_id long, embedding array<double>")
    return placed, vectors, actions, table


def host_rows(placed, host):
    rows = placed.where(F.col("host") == host).orderBy("stream_pos").collect()
    return rows, [(r.info_src, r.info_dst, r.action, r.src_kind, r.dst_kind) for r in rows]


def test_contexts_are_those_of_the_plain_model(made):
    placed, vectors, actions, table = made
    for block in (1, 7, conditional.BLOCK):
        got = {(r.host, r.event_id): r for r in conditional.replayed(placed, table, actions, block=block).collect()}
        assert len(got) == placed.count()
        for host in ("h1", "h2"):
            rows, events = host_rows(placed, host)
            want = plain(events, vectors, actions)
            assert any(s == d for s, d, *_ in events) and {c for *_, c in want} == set(conditional.CASES)
            for r, (x, y, case) in zip(rows, want):
                g = got[host, r.event_id]
                assert g.target_case == case and len(g.x) == 136 and np.allclose(g.x, x, atol=1e-12) and np.allclose(g.y, y, atol=1e-12)


def test_levels():
    src, dst = [1, 3, 1, 5, 2, 1], [2, 4, 5, 5, 6, 1]
    assert conditional.levels(src, dst).tolist() == [0, 0, 1, 2, 1, 2]


def test_a_gate_sees_each_score_before_the_states_move(made):
    placed, vectors, actions, table = made
    heads = conditional.Heads({c: Head(136, 64, seed=i, loss="cosine") for i, c in enumerate(conditional.CASES)})
    gate = conditional.UpdateGate(0.9, 0.05, 3.0)
    one = lambda x, y, case: heads.by_case[case].distance(x[None], y[None])[0]
    got = {(r.host, r.event_id): r.score for r in conditional.replayed(placed, table, actions, heads, gate).collect()}
    rows, events = host_rows(placed, "h1")
    for r, (x, y, case) in zip(rows, plain(events, vectors, actions, one, gate)):
        assert got["h1", r.event_id] == pytest.approx(one(x, y, case), abs=1e-8)


def test_heads_learn_each_case_its_own_map(spark):
    rng = np.random.default_rng(5)
    maps = {c: rng.normal(size=(6, 2)) @ rng.normal(size=(2, 4)) for c in conditional.CASES}
    data = [(c, x.tolist(), (x @ maps[c]).tolist()) for c in conditional.CASES for x in rng.normal(size=(200, 6))]
    table = spark.createDataFrame(data, "target_case string, x array<double>, y array<double>")
    heads, losses = conditional.fit_heads(table, rank=2, epochs=150)
    assert losses[-1]["all"] < 0.05 < losses[0]["all"]
    x = rng.normal(size=(50, 6))
    for c, other in zip(conditional.CASES, reversed(conditional.CASES)):
        assert heads.by_case[c].distance(x, x @ maps[c]).mean() < 0.05 < heads.by_case[c].distance(x, x @ maps[other]).mean()
    alone, _ = conditional.fit_heads(table.where("target_case = 'event_semantic'"), rank=2, epochs=3)
    assert np.array_equal(alone.by_case["both_cold_action"].w1, Head(6, 4, 2, 24, "cosine").w1)  # no rows: as it began
    with pytest.raises(ValueError):
        conditional.fit_heads(table.limit(0))


def test_stream_scores_and_decides_as_batch(spark):
    a = Audit.of(spark, SF)
    flow = a.placed.withColumn("ts", F.col("ts").cast("timestamp"))
    scorer = conditional.Scorer.fit(flow, attributes.summaries(a.nodes), epochs=3)
    scores = scorer.scores(flow)
    fitted = thresholds.fit_thresholds(scores.where("split = 'validation'")).cache()
    history = histories(scores.where("split <> 'test'"), a.nodes)
    rules = policies.tables(spark)
    columns = ["host", "event_id", "score", "target_case", "threshold", "threshold_level", "is_alert", "is_suppressed", "decision", "priority"]
    some = flow.where("host = 'h1' AND stream_pos < 80")
    want = online.judge(scorer.scores(some), fitted, history, a.nodes, *rules, "theia_v1").select(columns)
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        pdf = some.toPandas().sample(frac=1, random_state=3)
        last = pdf.iloc[:1].copy()
        last["ts"], last["host"] = pd.Timestamp("2200-01-01"), "end"
        os.makedirs(f"{base}/in")
        for i, part in enumerate((pdf.iloc[:40], pdf.iloc[40:], last)):
            spark.createDataFrame(part, some.schema).coalesce(1).write.parquet(f"{base}/{i}")
            shutil.move(glob.glob(f"{base}/{i}/part-*.parquet")[0], f"{base}/in/{i}.parquet")
            os.utime(f"{base}/in/{i}.parquet", (1000 + i, 1000 + i))
        stream = spark.readStream.schema(some.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").withWatermark("ts", "20000 days")
        query = online.judged_stream(scorer.scored_stream(stream), fitted, history, a.nodes, *rules, "theia_v1", f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
        got = spark.read.parquet(f"{base}/out").select(columns)
        as_rows = lambda df: sorted((*r[:2], round(r[2], 8), r[3], round(r[4], 8), *r[5:]) for r in map(tuple, df.collect()))
        assert as_rows(got) == as_rows(want) and got.count() == 80
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
