"""Recent distinct counts deal touches to nodes once."""

from tracewell.operators import windows


def test_a_sweep_deals_touches_once(spark):
    columns = "host string, node_id long, stream_pos long, event_id long, ts_us long, peer long, kind string, peer_kind string, action string"
    made = spark.createDataFrame([("h", i % 3, i, i, i * 1000000, i % 5, "process", "file", "a") for i in range(60)], columns)
    found = windows.recent(made, 7.0)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert found.count() == 60


def test_chains_order_nodes_once_and_need_no_places(spark, monkeypatch):
    """By counts worked out in plain code, also with tables that are too long to be sent to all tasks."""
    import math
    from collections import Counter

    ends = [(1, 9), (1, 9), (2, 9), (1, 1), (2, 9), (1, 9), (1, 1), (2, 1)]
    made = [("h", i, 1_000_000 * 3**i, "train" if i < 5 else "test", f"a{i % 2}", s, d, "process", "process") for i, (s, d) in enumerate(ends)]
    flow = spark.createDataFrame(made, "host string, event_id long, ts_us long, split string, action string, info_src long, info_dst long, src_kind string, dst_kind string")
    past, keys = {}, {}
    for _, i, us, _, action, s, d, *_ in made:
        for node in dict.fromkeys((s, d)):
            for side in "SD" if s == d else "S" if node == s else "D":
                keys.setdefault(i, []).extend((side, a, action, min(24, int(math.log2((us - t) // 1_000_000 + 1))), min(k, 3)) for k, (a, t) in enumerate(past.get(node, [])[:4]))
            past[node] = [(action, us), *past.get(node, [])]
    known = Counter(k for i in range(5) for k in keys.get(i, []))
    want = {i: [-math.log((known[k] + 1) / (sum(known.values()) + 100)) for k in keys[i]] for i in (5, 6, 7)}
    for few in (windows.FEW_TRANSITIONS, 0):
        monkeypatch.setattr(windows, "FEW_TRANSITIONS", few)
        monkeypatch.setattr(windows, "FEW_ROLES", few)
        got = {r.event_id: r for r in windows.chain_profile(flow, "split = 'train'", "split = 'test'").collect()}
        assert set(got) == set(want)
        for i, r in got.items():
            assert abs(r.max_rarity - max(want[i])) < 1e-9 and abs(r.mean_rarity - sum(want[i]) / len(want[i])) < 1e-9
