"""Shared states, cascades and sweeps against plain models; streams against batch."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F
from streams import streamed

from tracewell.operators import alerting, clusters, flow, prefix, variants, windows
from tracewell.sources.audit import BY_ACTION, Audit
from tracewell.streaming import cascades, folds, merging
from tracewell.streaming.fold import folded, folded_stream
from tracewell.streaming.folds import KEEP, LAMBDA, RHO, SCALE, message

SF = "/root/testdata/sf0.001"


class Shared:
    """A state and who holds it."""

    def __init__(self, value, holders, kind):
        self.value, self.holders, self.kind, self.at = value, holders, kind, 0


def plain(events, m):
    """Every node's state object after each event, by scanning all states."""
    held, clock, out = {}, 0, []
    unit = lambda v: v / n if (n := np.linalg.norm(v)) > 1e-8 else v
    sign = lambda v: unit(np.fft.rfft(v).real[:17] if m.mode == "fourier" else v)
    bucket = lambda v: tuple(sign(v)[: m.bits] > 0)

    def change(node, kind, msg):
        nonlocal clock
        own = held.get(node)
        value = KEEP * (0 if own is None else own.value) + (1 - KEEP) * msg
        if own is not None:
            own.holders.discard(node)
        clock += 1
        others = {id(s): s for s in held.values() if s.holders and s.kind == kind and bucket(s.value) == bucket(value)}
        ranked = sorted(others.values(), key=lambda s: (float(sign(s.value) @ sign(value)), s.at))
        if ranked and float(sign(ranked[-1].value) @ sign(value)) >= m.least:
            best = ranked[-1]
            best.value = (best.value * len(best.holders) + value) / (len(best.holders) + 1)
            best.holders.add(node)
        else:
            best = Shared(value, {node}, kind)
        best.at, held[node] = clock, best

    for e in events:
        z, scale = message(e.action, e.src_kind, e.dst_kind), SCALE[e.src_kind]
        read = held[e.info_src].value.copy() if e.info_src in held else np.zeros(64)
        if e.info_src != e.info_dst:
            change(e.info_src, e.src_kind, RHO[e.action] * scale * z)
        change(e.info_dst, e.dst_kind, unit(z + LAMBDA[e.action] * scale * read))
        out.append({n: (id(s), s.value) for n, s in held.items()})
    return out


@pytest.mark.parametrize("m", [merging.Merging(), merging.Merging("time_domain", 0.95), merging.Merging("none")])
def test_shared_states_after_every_event(spark, m):
    events = Audit.of(spark, SF).placed.where("host = 'h1' AND stream_pos < 500").orderBy("stream_pos").collect()
    states, step = {}, m.step()
    want = plain(events, m) if m.mode != "none" else [None] * len(events)
    copies = joins = 0
    for e, expected in zip(events, want):
        *_, nodes, places, copied, joined = step(states, e)
        copies, joins = copies + copied, joins + joined
        at = {int(k[1:]): int(v[0]) for k, v in states.items() if k[0] == "n" and k[1:].isdigit()}
        holders = {int(k[1:]): int(v[0]) for k, v in states.items() if k[0] == "c"}
        # counts add up, every node reads a state, every state is listed once and in its own bucket
        assert len(at) == nodes and len(holders) == places == len(set(at.values()))
        assert all(sum(p == place for p in at.values()) == n for place, n in holders.items())
        listed = [(k, int(p)) for k, v in states.items() if k[0] == "b" for p in v]
        assert sorted(p for _, p in listed) == sorted(holders)
        assert all(m.bucket(m.signature(np.asarray(states[f"s{p}"]))) == int(k.split(":")[1]) == int(states[f"c{p}"][2]) for k, p in listed)
        if expected is not None:
            assert all(np.allclose(states[f"s{at[n]}"], value, atol=1e-9) for n, (_, value) in expected.items())
            assert len({(at[n], i) for n, (i, _) in expected.items()}) == len(set(at.values())) == len({i for i, _ in expected.values()})
    assert (copies > 0 and joins > 0) == (m.mode != "none")


def test_places_of_nodes_and_their_stream(spark):
    flow_ = Audit.of(spark, SF).placed.where("host = 'h1' AND stream_pos < 120").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = folded(flow_, merging.merging_fold()).cache()
    got = {r.node_id: (r.n, r.cluster) for r in clusters.last_places(rows).collect()}
    last = rows.orderBy(F.desc("stream_pos")).first()
    assert len(got) == last.nodes and len({c for _, c in got.values()}) == last.states
    as_rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert as_rows(streamed(spark, flow_, lambda s: folded_stream(s, merging.merging_fold()))) == as_rows(rows)


def test_cascades_of_a_stream_expire_by_timers(spark):
    a = Audit.of(spark, SF)
    low = a.thresholds.withColumn("thr", F.lit(40000.0))
    alerts = alerting.alerts(a.test, low, BY_ACTION).withColumn("excess", F.col("score") - F.col("thr"))
    touched = flow.touches(alerts).where("host IN ('h1', 'h2')").withColumn("ts", F.col("ts").cast("timestamp"))
    cascade = cascades.Cascade(seconds=86400.0 * 20, most_seconds=86400.0 * 50)
    want = cascades.cascaded(touched, cascade)
    decisions = {r.decision: r["count"] for r in want.groupBy("decision").count().collect()}
    assert decisions["confirmed"] > 5 and decisions["expired"] > 5
    as_rows = lambda df: sorted(map(str, map(tuple, df.where("host <> 'end'").collect())))
    assert as_rows(streamed(spark, touched, lambda s: cascades.cascaded_stream(s, cascade))) == as_rows(want)


def test_cascades_against_a_plain_model(spark):
    rng = random.Random(2)
    data = sorted({(rng.randint(0, 3000), i) for i in range(400)})
    rows = [("h", i % 5, us * 1_000_000, i, rng.choice("ab"), rng.choice("xy"), rng.random()) for us, i in data]
    made = spark.createDataFrame(rows, "host string, node_id long, ts_us long, event_id long, action string, peer_kind string, excess double")
    c = cascades.Cascade(seconds=40, most_seconds=90, most_events=4, least_events=3, least_kinds=3)
    want = []
    for node in range(5):
        open_, done = [], False
        for _, _, us, i, action, kind, excess in [r for r in rows if r[1] == node] + [("h", node, 10**15, -1, "", "", 0.0)]:
            if done:
                break
            if open_ and us > min(open_[-1][0] + 40_000_000, open_[0][0] + 90_000_000):
                want.append((node, "expired", [x[1] for x in open_]))
                open_ = []
            if i < 0:
                break
            open_.append((us, i, action + kind))
            if len(open_) >= 3 and len({x[2] for x in open_}) >= 3:
                want.append((node, "confirmed", [x[1] for x in open_]))
                done = True
            elif len(open_) == 4:
                want.append((node, "expired", [x[1] for x in open_]))
                open_ = []
    got = sorted((r.node_id, r.decision, r.events) for r in cascades.cascaded(made, c).collect())
    assert got == sorted(want) and {d for _, d, _ in want} == {"confirmed", "expired"}


def test_recent_counts_of_a_hub(spark):
    """100,000 touches of one node, with ties in time, against a window that moves by one."""
    rng = random.Random(4)
    us = sorted(rng.randint(0, 2_000_000) for _ in range(100_000))
    rows = [("h", 1, i, 10 * i, t * 1000, rng.randint(0, 3000), rng.choice("ab"), rng.choice("uv"), "process") for i, t in enumerate(us)]
    made = spark.createDataFrame(rows, "host string, node_id long, stream_pos long, event_id long, ts_us long, peer long, action string, peer_kind string, kind string")
    got = {r.stream_pos: r for r in windows.recent(made, 1.5).collect()}
    assert len(got) == len(rows)
    held, peers, kinds = deque(), {}, {}
    for _, _, pos, _, t, peer, action, kind, _ in rows:
        while held and held[0][0] < t - 1_500_000:
            _, p, k = held.popleft()
            for counts, x in ((peers, p), (kinds, k)):
                counts[x] -= 1
                if not counts[x]:
                    del counts[x]
        before = len(peers)
        held.append((t, peer, kind))
        peers[peer], kinds[kind] = peers.get(peer, 0) + 1, kinds.get(kind, 0) + 1
        assert (got[pos].recent_peers, got[pos].kinds) == (before, len(kinds)), pos


def test_ordering_computes_its_rows_once(spark):
    """Range partitioning samples its input: what the rows are computed from must not be computed again."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), F.rand(1).alias("wide"))
    counted = rows.mapInArrow(count, rows.schema)
    assert prefix.running(counted.select("k", "i"), ["k"], [F.col("i")], {"n": F.lit(1)}).agg(F.sum("n")).first()[0] > 0
    assert seen.value == 20_000
    assert prefix.numbered(counted.select("k", "i"), ["k"], [F.col("i")], "n").agg(F.max("n")).first()[0] == 6667
    assert seen.value == 40_000


class Event:
    def __init__(self, pos, us, src, dst, score):
        self.host, self.stream_pos, self.event_id, self.ts_us, self.info_src, self.info_dst, self.score = "h", pos, pos, us, src, dst, score


def test_risks_are_bounded_and_the_least_goes(monkeypatch):
    """Eviction order, time to live and size after every event, against a scan of all nodes."""
    import math

    p = folds.Parameters(most_risks=12, risk_ttl=600.0, decay=300.0)
    monkeypatch.setattr(folds, "P", p)
    rng = random.Random(6)
    states, risks, largest = {}, {}, 0
    us = 0
    for pos in range(3000):
        us += rng.choice([0, 1, 20, 700 if pos % 500 == 0 else 3]) * 1_000_000
        src = rng.randint(0, 40)
        e = Event(pos, us, src, src if rng.random() < 0.1 else rng.randint(0, 40), rng.random() * 1e5)
        now, want = us / 1e6, []
        for n in [n for n, (_, _, t, _) in sorted(risks.items(), key=lambda x: x[1][3]) if t < now - p.risk_ttl]:
            del risks[n]
            want.append(n)
        for k, n in enumerate(dict.fromkeys((e.info_src, e.info_dst))):
            r, c, t, _ = risks.get(n, (0.0, 0, now, 0))
            risks[n] = (max(r * math.exp(-(now - t) / p.decay), e.score / 1e4 + math.log1p(c) - 0.1 * c**0.5), c + 1, now, 2 * pos + k)
        while len(risks) > p.most_risks:
            least = min((n for n in risks if n not in (e.info_src, e.info_dst)), key=lambda n: (math.log(max(risks[n][0], 1e-300)) + risks[n][2] / p.decay, n))
            del risks[least]
            want.append(least)
        *_, src_risk, dst_risk, n, gone = folds._bounded_risk(states, e)
        assert gone == want and n == len(risks) <= p.most_risks
        assert abs(src_risk - risks[e.info_src][0]) < 1e-8 and abs(dst_risk - risks[e.info_dst][0]) < 1e-8
        largest = max(largest, states["heap"][0])
        queued = states["queue"][1] - states["queue"][0]
        assert sum(k[0] == "h" and k != "heap" for k in states) == states["heap"][0] and sum(k[0] == "q" and k != "queue" for k in states) == queued
    assert largest <= 4 * 16 + 2


def test_risk_goes_back_along_the_last_neighbours(monkeypatch):
    p = folds.Parameters(high=100.0, decay=1e12, neighbours=2, hops=2, back=0.5)
    monkeypatch.setattr(folds, "P", p)
    states = {}
    flows = [(1, 2), (9, 2), (3, 2), (4, 2), (5, 4), (2, 6)]  # 2 remembers 3 and 4; 4 remembers 5
    for pos, (s, d) in enumerate(flows):
        assert folds._propagated(states, Event(pos, pos, s, d, 10.0))[3:] == (10.0, 0)
    # 200 from 2 to 7: 60 to both ends, 30 to 3 and 4, 15 to 5; 1 and 9 are forgotten, 6 lies ahead
    assert folds._propagated(states, Event(9, 9, 2, 7, 200.0))[3:] == (200.0, 3)
    assert {k: round(v[0], 6) for k, v in states.items() if k[0] == "r"} == {"r2": 60.0, "r7": 60.0, "r3": 30.0, "r4": 30.0, "r5": 15.0}
    # an event of 5 is raised by half of its risk
    assert folds._propagated(states, Event(10, 10, 5, 8, 1.0))[3:] == (8.5, 0)


def test_memory_keeps_far_vectors_out():
    """Means, distances and quarantine against sums over all that was kept."""
    rng = np.random.default_rng(3)
    states, kept, gaps, out = {}, [], [], 0
    for i in range(300):
        z = rng.normal(size=6) * (30 if i % 37 == 36 else 1)
        e = Event(i, i, 1, 2, 0.0)
        e.action, e.src_kind, e.dst_kind, e.z = "a", "process", "file", z
        *_, gap, quarantined = folds._memory(states, e)
        want = np.sqrt(((z - np.mean(kept, axis=0)) ** 2).mean()) if len(kept) >= 10 else 0.0
        far = len(gaps) >= 10 and want > np.mean(gaps) + 4 * np.std(gaps)
        assert abs(gap - want) < 1e-8 and quarantined == far
        if not far:
            if len(kept) >= 10:
                gaps.append(want)
            kept.append(z)
        out += far
    assert 5 <= out <= 12


def test_decay_rates_are_learned(spark):
    """The gradient against finite differences, and rates that follow how vectors move."""
    rng = np.random.default_rng(7)
    zs, gamma = rng.normal(size=(30, 5)), rng.uniform(0.05, 1.5, 5)

    def loss(g):
        node = variants.Sensitivity(g)
        return sum(node.meet(z)[0] for z in zs)

    node = variants.Sensitivity(gamma)
    gradient = sum(node.meet(z)[1] for z in zs)
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        assert abs((loss(gamma + step) - loss(gamma - step)) / 2e-6 - gradient[i]) < 1e-5
    # dimension 0 stays for long and then moves (fast states are best), dimension 1 is noise about 0.5 (slow ones are)
    table = {f"a{i}": np.array([float(i // 20), float(v)]) for i, v in enumerate(0.5 + rng.normal(size=200))}
    made = spark.createDataFrame([("h", n, 1000 * i, i, f"a{i}", "k", "k") for n in range(3) for i in range(200)], "host string, node_id long, ts_us long, event_id long, action string, kind string, peer_kind string")
    found, losses = variants.fit_gamma(made, lambda a, k, p: table[a], 2, epochs=25, rate=0.3)
    assert losses[-1] < losses[0] and found[0] > 3 * found[1]


def test_packed_sequences_have_the_losses_of_single_steps(spark):
    """Long and short nodes, also in one batch, against vectors met one by one; touches are packed two bytes each."""
    rng = np.random.default_rng(5)
    lengths = {("h1", 1): 700, ("h1", 2): 1, ("h1", 3): 256, ("h2", 3): 513, ("h2", 4): 40, ("h2", 5): 2}
    table = {f"a{i}": rng.normal(size=4) for i in range(6)}
    touches = [(h, n, 10 * i, i, f"a{rng.integers(6)}", "k", "k") for (h, n), length in lengths.items() for i in range(length)]
    gamma, want = rng.uniform(0.001, 1.5, 4), np.zeros(6)
    for key in lengths:
        node = variants.Sensitivity(gamma)
        for k, e in enumerate(t for t in touches if t[:2] == key):
            loss, gradient = node.meet(table[e[4]])
            want += np.concatenate(([loss, k > 0], gradient))
    rows = spark.createDataFrame(touches, "host string, node_id long, ts_us long, event_id long, action string, kind string, peer_kind string")
    packed = variants.packed_sequences(rows.coalesce(1).sortWithinPartitions("host", "node_id", "ts_us", "event_id")).collect()
    assert len(packed) == 1 and len(packed[0].codes) == 2 * len(touches)
    z, codes, sizes = np.stack([table[a] for a in packed[0].action]), np.frombuffer(packed[0].codes, "<u2"), np.frombuffer(packed[0].sizes, "<i8")
    assert sizes.tolist() == list(lengths.values())
    for chunk in (1, 7, 256, 1000):
        assert np.allclose(variants.sequence_loss(gamma, z, codes, sizes, chunk), want, rtol=1e-9, atol=1e-9)
