"""Twelve events small enough to work out by hand: what each operator must say about them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import policies
from tracewell.operators import alerting, attributes, clusters, conditional, evaluation, flow, nodes, online, prefix, profiles, quantiles, relational, thresholds, variants, windows
from tracewell.sources.audit import Audit
from tracewell.sources.files import read_truth
from tracewell.streaming import cascades

# processes 11 to 13 write to addresses 51 to 55: event, second, process, address, score
TRAIN = [(10, 5, 11, 51, 1.0), (11, 9, 11, 52, 2.0), (12, 20, 12, 51, 1.5), (13, 30, 11, 51, 1.0), (14, 31, 13, 53, 3.0)]
VALIDATION = [(40, 400, 12, 52, 2.0), (41, 460, 11, 51, 6.0), (42, 500, 13, 54, 4.0)]
TEST = [(70, 900, 11, 51, 3.0), (71, 930, 12, 54, 7.0), (72, 990, 13, 54, 8.0), (73, 1000, 12, 55, 6.5)]
SPLITS = {"train": TRAIN, "validation": VALIDATION, "test": TEST}
EVENTS = [(*e, split) for split, events in SPLITS.items() for e in events]
ADDRESSES = {51: ("10.1.1.1", "22"), 52: ("10.1.1.2", "53"), 53: ("10.2.0.3", "8080"), 54: ("192.0.2.9", "7000"), 55: ("192.0.2.14", "7001")}
# process 12 and address 54 are the attack's
ATTACK = {12, 54}


@pytest.fixture(scope="module")
def audit(spark):
    rows = [("h", i, 1_000_000 * t, p, a, "EVENT_WRITE", split, s) for i, t, p, a, s, split in EVENTS]
    events = spark.createDataFrame(rows, "host string, event_id long, ts_us long, src_id long, dst_id long, action string, split string, score double").withColumn("ts", F.timestamp_micros("ts_us"))
    own = [(p, f"P{p}", "process", f"/opt/run{p}", None, None, None) for p in (11, 12, 13)] + [(a, f"N{a}", "netflow", None, None, *name) for a, name in ADDRESSES.items()]
    known = spark.createDataFrame(own, "node_id long, uuid string, kind string, path string, cmd string, dst_addr string, dst_port string")
    truth = spark.createDataFrame([(54, "N54"), (12, "P12")], "node_id long, uuid string")
    spans = spark.createDataFrame([("w", 920, 995), ("late", 2000, 2001)], "name string, a long, b long").select("name", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"))
    return Audit(known, events, truth, spans)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_flow_and_labels(audit):
    assert rows(audit.flow, "event_id", "info_src", "info_dst") == [(i, p, a) for i, _, p, a, *_ in EVENTS]
    labels = dict(rows(audit.labelled, "event_id", "label"))
    assert labels == {i: (p in ATTACK) + (a in ATTACK) for i, _, p, a, *_ in EVENTS} and [labels[i] for i in (70, 71, 72, 73)] == [0, 2, 1, 1]
    assert rows(audit.placed, "stream_pos", "event_id") == [(k, e[0]) for k, e in enumerate(EVENTS)]


def test_history_of_nodes(audit):
    before = {(r.event_id, r.node_id): r.n_before for r in flow.counts_before(audit.touch).collect()}
    # 11 wrote in 10, 11, 13 and 41; 51 was written to in 10, 12, 13 and 41
    assert before[70, 11] == 4 and before[70, 51] == 4 and before[71, 12] == 2 and before[72, 54] == 2 and before[10, 11] == 0 and before[73, 55] == 0
    cases = dict(rows(audit.cased, "event_id", "target_case"))
    # the first events of the three processes, each to an address met once at most
    assert {i for i, c in cases.items() if c == "both_cold_action"} == {10, 12, 14}


def test_thresholds_alerts_and_coverage(audit):
    # three validation scores 2, 4, 6: rank ceil(0.99 * 2) = 2
    assert rows(audit.thresholds, "action", "n", "thr", "vmax") == [("EVENT_WRITE", 3, 6.0, 6.0)]
    assert rows(audit.alerts, "event_id") == [(71,), (72,), (73,)]
    covered = {r.node_id: (r.first_alert, r.last_alert, r.n_src, r.n_dst, r.max_score) for r in thresholds.covered_nodes(audit.alerts).collect()}
    assert covered[12] == (71, 73, 2, 0, 7.0) and covered[54] == (71, 72, 0, 2, 8.0) and set(covered) == {12, 13, 54, 55}
    fitted = {r.level: (r.n, r.thr, r.eligible) for r in thresholds.fit_thresholds(audit.cased.where("split = 'validation'")).collect()}
    assert fitted["global"] == (3, 6.0, False) and fitted["case"] == (3, 6.0, False)
    resolved = thresholds.resolve(audit.cased.where("split = 'test'"), thresholds.fit_thresholds(audit.cased.where("split = 'validation'")), [(2, 9.0), (None, 0.5)]).collect()
    # three validation rows in the group: its maximum 6 and 0.5 are over the global 6
    assert {r.threshold for r in resolved} == {6.5} and {r.threshold_level for r in resolved} == {"global"}


def test_evaluation(audit):
    got = {r.mode: r for r in evaluation.event_confusion(audit.judged, ["host"]).collect()}
    # 71 is on an attack (both ends), 72 and 73 are suspect, 70 is benign
    assert (got["strict"].tp, got["strict"].fp, got["strict"].fn, got["strict"].tn) == (1, 2, 0, 1) and (got["relaxed"].tp, got["relaxed"].fp, got["relaxed"].fn, got["relaxed"].tn) == (1, 0, 0, 1)
    assert got["strict"].precision == pytest.approx(1 / 3) and got["strict"].fpr == pytest.approx(2 / 3) and got["relaxed"].recall == 1.0
    # ranks: 72, 71, 73 (all +), 70
    assert evaluation.average_precision(audit.labelled_test, ["host"]).first()["average_precision"] == pytest.approx(1.0)
    assert evaluation.average_precision(audit.labelled_test, ["host"], "label = 0").first()["average_precision"] == pytest.approx(1 / 4)
    assert evaluation.average_precision(audit.labelled_test, ["host"], "label = 1").first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert evaluation.roc_auc(audit.labelled_test, ["host"]).first()["auc"] == 1.0 and evaluation.roc_auc(audit.labelled_test, ["host"], "label = 0").first()["auc"] == 0.0
    assert rows(evaluation.recall_at_k(audit.labelled_test, ["host"], [1, 2, 3]), "k", "recall") == [(1, pytest.approx(1 / 3)), (2, pytest.approx(2 / 3)), (3, 1.0)]
    budget = {r.budget: r for r in evaluation.budget_tail(audit.labelled_test, ["host"], [1, 3]).collect()}
    assert (budget[3].tp, budget[3].fp, budget[3].threshold, budget[3].tp_actors, budget[3].first_tp_rank) == (3, 0, 6.5, 2, 1)
    sets = {r["mode"]: r for r in evaluation.node_confusion(audit.judged, audit.truth, ["host"]).collect()}
    # alerted: 12+, 13, 54+, 55; not: 11, 51; 13 and 55 lie on suspect events
    assert (sets["strict"].tp, sets["strict"].fp, sets["strict"].fn, sets["strict"].tn) == (2, 2, 0, 2) and (sets["relaxed"].fp, sets["relaxed"].tn) == (0, 2)
    actor = evaluation.actor_confusion(audit.judged, ["host"]).first()
    # 13 wrote to the attack's address
    assert (actor.tp, actor.fp, actor.fn, actor.tn) == (2, 0, 0, 1)
    spans = {r.name: (r.n_alerts, r.detected, r.seconds_to_detect) for r in evaluation.window_metrics(audit.alerts, audit.windows).collect()}
    assert spans == {"w": (2, True, 10.0), "late": (0, False, None)}
    cover = evaluation.coverage_eval(audit.alert_touch, audit.truth).first()
    # 13 and 55 are only on suspect events, so they are ignored
    assert (cover.tp, cover.strict_fp, cover.ignored, cover.fp, cover.recall) == (2, 2, 2, 0, 1.0)
    sweep = {r.k: r for r in evaluation.topk_sweep(evaluation.rank_nodes(audit.node_scores, audit.truth, ["host"]), ["host"], [1, 2, 3, 9]).collect()}
    # 13 and 54 have 8, then 12 with 7, 55 with 6.5, 11 and 51 with 3
    assert (sweep[1].tp, sweep[1].fp) == (0, 1) and (sweep[2].tp, sweep[2].fp, sweep[2].fn) == (1, 1, 1) and (sweep[3].tp, sweep[3].fp, sweep[3].fn) == (2, 1, 0) and (sweep[9].tp, sweep[9].fp) == (2, 4)


def test_suppression_and_policies(spark, audit):
    rules, defaults = policies.tables(spark, rules=[("p", "EVENT_WRITE", "process", "netflow", "evidence")], defaults=[("p", "alert"), ("q", "alert")])
    got = rows(alerting.decided(audit.judged, rules, defaults, "score >= thr"), "event_id", "policy", "decision", "priority", "is_final")
    assert got[:2] == [(70, "p", "not_alert", "", False), (70, "q", "not_alert", "", False)] and got[2:4] == [(71, "p", "evidence", "low", False), (71, "q", "alert", "default", True)]
    past = audit.history.where("split <> 'test'").withColumn("endpoint", F.lit("192.0.2.9:7000"))
    held = alerting.suppressed(audit.history.where("split = 'test'"), past, audit.thresholds, ["action"], least=2, margin=2.0)
    # 12 and 13 met the endpoint twice each (made so above); of their alerts 7 is less than 2 over 6, 8 is not
    assert rows(held.where("is_suppressed"), "event_id", "history_count", "match_level") == [(71, 2, "src_endpoint_action")]


def test_rarity(audit):
    train = audit.flow.where("split = 'train'")
    got = {r.event_id: r for r in profiles.profile_rarity(train, audit.test).collect()}
    # of five training events three are of 11 and two of these to 51
    assert got[70].src_rarity == pytest.approx(-math.log(4 / 6)) and got[72].src_rarity == pytest.approx(-math.log(2 / 6))
    assert got[70].edge_rarity == pytest.approx(-math.log(3 / 6)) and got[73].edge_rarity == pytest.approx(-math.log(1 / 6)) and got[70].relation_rarity == pytest.approx(0)
    nll = {r.event_id: r for r in profiles.conditional_nll(train, audit.test).collect()}
    assert nll[70].action_nll == pytest.approx(-math.log(6 / 15)) and nll[70].dst_kind_nll == pytest.approx(-math.log(6 / 8))
    tail = {r.event_id: r.p_value for r in relational.tail(audit.flow, ["action"], "split = 'validation'", "split = 'test'").collect()}
    # 2, 4, 6 are the reference
    assert tail == {70: 3 / 4, 71: 1 / 4, 72: 1 / 4, 73: 1 / 4}


def test_windows(audit):
    got = {(r.event_id, r.node_id): r for r in windows.recent(audit.touch_placed, 100.0).collect()}
    assert len(got) == 2 * len(EVENTS)
    # before 72, 54 met 12 within 100 seconds; before 71, 12 met nobody; the event itself counts for kinds, actions and transitions
    assert [got[k].recent_peers for k in ((72, 54), (73, 12), (71, 12), (13, 11), (13, 51))] == [1, 1, 0, 2, 2]
    assert (got[72, 54].kinds, got[72, 54].actions, got[72, 54].transitions) == (1, 1, 1)
    gaps = {r.event_id: r for r in windows.time_gaps(audit.placed).collect()}
    assert gaps[10].global_gap == 0 and gaps[70].global_gap == pytest.approx(math.log(401)) and gaps[70].src_gap == pytest.approx(math.log(441)) and gaps[70].edge_gap == pytest.approx(math.log(441)) and gaps[73].edge_gap == 0
    pool = {r.node_id: r for r in windows.node_pool(audit.touch.withColumn("residual", F.col("score") - 1), m=2).collect()}
    # 12 wrote four times to four addresses; its best are 7 and 6.5
    assert (pool[12].n, pool[12].chains, pool[12].mass, pool[12].residual_mass) == (4, 4, 13.5, 11.5) and pool[12].base_conf_repeat_chain == pytest.approx(13.5 + math.log(2) + math.log(5))
    best = {r.checkpoint: (r.best_node, r.best_score) for r in windows.pool_checkpoints(audit.touch_placed, 4).collect()}
    # 11 has 1 + 2 + 1 after four events, 54 has 4 + 7 + 8 in the end
    assert best[0] == (11, 4.0) and best[2] == (54, 19.0)


def test_node_ranking(audit):
    found = {r.node_id: r for r in nodes.ranked(nodes.evidence(alerting.with_threshold(audit.touch.where("split = 'test'"), audit.thresholds, ["action"]))).collect()}
    # soft evidence counts from half the threshold on: 7 - 3 and 6.5 - 3
    assert (found[12].n_high, found[12].soft, found[12].peers) == (2, 7.5, 2) and [found[n].rk for n in (13, 54, 12, 55)] == [1, 2, 3, 4]


def test_cascades_by_hand(audit):
    # 12 alerts at 930 and 1000 (71, 73), 54 at 930 and 990 (71, 72), 13 and 55 once (72, 73), all with one action and kind of peer
    one = cascades.Cascade(seconds=65, least_kinds=1)
    columns = ("node_id", "decision", "at_us", "event_id", "first_event", "n_events", "n_kinds")
    second = 1_000_000
    got = rows(online.cascades(audit.alerts, one), *columns)
    assert got == [
        (12, "expired", 995 * second, 71, 71, 1, 1), (12, "expired", 1065 * second, 73, 73, 1, 1), (13, "expired", 1055 * second, 72, 72, 1, 1),
        (54, "confirmed", 990 * second, 72, 71, 2, 1), (55, "expired", 1065 * second, 73, 73, 1, 1),
    ]
    longer = rows(online.cascades(audit.alerts, cascades.Cascade(seconds=70, least_kinds=1)), *columns)
    assert (12, "confirmed", 1000 * second, 73, 71, 2, 1) in longer and len(longer) == 4
    # 54's second alert is further over its threshold than its first, 12's is not
    assert dict(rows(online.cascades(audit.alerts, cascades.Cascade(seconds=70, least_kinds=1)), "node_id", "consistency")) == {12: 0.5, 13: 1.0, 54: 1.0, 55: 1.0}
    both = rows(cascades.confirmed_events(online.cascades(audit.alerts, cascades.Cascade(seconds=70, least_kinds=1))), "event_id", "at_us")
    assert both == [(71, 990 * second), (72, 990 * second), (73, 1000 * second)]
    # two kinds of evidence never come; no more than one alert a candidate, or no delay beyond the first alert's
    assert {r[0] for r in rows(online.cascades(audit.alerts), "decision")} == {"expired"}
    assert {r[0] for r in rows(online.cascades(audit.alerts, cascades.Cascade(least_kinds=1, least_events=3, most_events=1)), "n_events")} == {1}
    assert {r[0] for r in rows(online.cascades(audit.alerts, cascades.Cascade(most_seconds=30, least_kinds=1)), "decision")} == {"expired"}


def test_evidence(audit):
    found = {r.event_id: r for r in online.attack_evidence(alerting.with_threshold(audit.placed, audit.thresholds, ["action"]), F.lit("write"), 1000.0).collect()}
    # 73 is a new edge 0.5 over its threshold; 12 met 51, 52 and 54 before
    assert (found[73].excess, found[73].peers, found[73].actions, found[73].kinds) == (0.5, 3, 1, 2)
    assert (found[71].excess, found[71].peers, found[71].kinds) == (1.0, 2, 1) and (found[72].excess, found[72].peers, found[72].kinds) == (0.0, 2, 0)
    risk = {r.node_id: r for r in online.node_evidence_risk(audit.events.sparkSession.createDataFrame(list(found.values()))).collect()}
    assert risk[55].events == 1 and risk[55].risk == pytest.approx(math.log(1.5) + math.log(4) + 2 * math.log(2) + math.log(2))


def test_online_scorer_decides_every_test_event(spark, audit):
    scorer = conditional.Scorer.fit(audit.placed, attributes.summaries(audit.nodes), epochs=3)
    got = online.conditional_scoring(scorer.scores(audit.placed), audit.nodes, *policies.tables(spark)).collect()
    assert sorted(r.event_id for r in got) == [70, 71, 72, 73] and len(scorer.losses) == 3
    assert all(r.is_alert == (r.score >= r.threshold) and (r.decision == "not_alert") == (not r.is_alert) for r in got)
    test, pool = online.residual_scoring(audit.placed, 1.0, 3.0)
    cut = {r.event_id: r for r in test.collect()}
    assert set(cut) == {70, 71, 72, 73} and all(r.is_alert == (r.score >= r.thr) for r in cut.values()) and pool.count() == 6


def test_states_in_closed_form_are_those_of_the_fold(spark, audit):
    from tracewell.streaming.fold import folded
    from tracewell.streaming.folds import KEEP, NODE_FOLDS, message

    last = {}
    for r in folded(audit.touch_placed, NODE_FOLDS["node_state_ema"]).collect():
        last[r.node_id] = max(last.get(r.node_id, (-1, 0)), (r.stream_pos, r.norm))
    states = {r.node_id: (r.n, math.sqrt(sum(x * x for x in r.state))) for r in clusters.final_states(audit.touch).collect()}
    assert set(states) == set(last) and all(states[k][1] == pytest.approx(last[k][1], abs=1e-8) for k in last) and states[12][0] == 4
    # all events are alike, so a node's state depends on how many it had; of each kind that with the most leads
    met = {51: 5, 52: 2, 53: 1, 54: 3, 55: 1, 11: 5, 12: 4, 13: 3}
    own = {n: (1 - KEEP**c) * message("EVENT_WRITE", *(("process", "netflow") if n < 50 else ("netflow", "process"))) for n, c in met.items()}
    lead = {n: 11 if n < 50 else 51 for n in met}
    near = {n: float(own[n] @ own[lead[n]]) / float(np.linalg.norm(own[n]) * np.linalg.norm(own[lead[n]])) for n in met}
    merged = {r.node_id: r.cluster for r in clusters.merged_states(clusters.final_states(audit.touch), least=0.97, bits=1).collect()}
    assert merged == {n: lead[n] if near[n] >= 0.97 else n for n in met} and len(set(merged.values())) < len(met)
    summary = clusters.compression(clusters.merged_states(clusters.final_states(audit.touch), least=0.97, bits=1)).first()
    assert (summary.logical_states, summary.physical_states) == (8, len(set(merged.values())))


def test_process_words(spark):
    lines = {
        ("/bin/bash", "bash -c /tmp/run.sh"): ["EXE_bash", "DIR_bin", "FLAG_c_run_sh"],
        ("/usr/bin/python3.8", "python3.8 /opt/main.py --port 8080 -v mode=fast PATH=/usr/bin > out.log && ls"): ["EXE_python3", "DIR_bin", "FLAG_port_N_129p", "FLAG_v_mode_fast", "ENV_path_bin", "REDIR_OUT", "AND", "ARG_python3_8"],
        ("/a/wget", "wget 'http://example.org/a b' --tries 5 -q -O- x=1"): ["EXE_wget", "DIR_a", "FLAG_tries_N_5_8", "FLAG_q", "FLAG_o_x_1", "ARG_a_b"],
        (None, None): ["PROC_na"],
        (None, 'sshd "unterminated'): ["EXE_sshd", "ARG_unterminated"],
        ("/usr/sbin/nginx", None): ["EXE_nginx", "DIR_sbin"],
    }
    df = spark.createDataFrame([("process", p, c) for p, c in lines], "kind string, path string, cmd string")
    assert {(r.path, r.cmd): r.tokens for r in attributes.process_tokens(df).collect()} == lines


def test_path_tokens_and_signatures(spark):
    paths = {
        "/tmp//a/Report-2024.final.PDF": ["ROOT_tmp", "DIR_a", "PATH_report_2024_final"], "C:\\Users\\x\\f.txt": ["ROOT_rel", "DIR_x", "PATH_f_txt"], "/": ["PATH_na"], "": ["PATH_na"],
        "/etc/123e4567-e89b-12d3-a456-426614174000": ["ROOT_etc", "DIR_etc", "PATH_uuid"], "/var/0123456789abcdef/9": ["ROOT_var", "DIR_hex", "PATH_num"], "rel": ["ROOT_rel", "PATH_rel"],
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.t for r in df.select("path", attributes.path_tokens(F.col("path")).alias("t")).collect()} == paths
    values = {"TRUE": "true", "17": "N_17_32", "/a/b.so.1": "b_so", "a|b;c": "L_3_4", "10.0.0.1": "IP_10_0_0_1", "10.0.0.999": "10_0_0_999", "a:b:c": "L_3_4", "Some text!": "some_text", " ": "na"}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.v: r.s for r in df.select("v", attributes.value_signature(F.col("v")).alias("s")).collect()} == values


def test_truth_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("uuid,info,old_index\nu1,x,7\n\n,blank,8\nu1,x,7\n")
    (tmp_path / "b.tsv").write_text("u2\ty, z\t9\nu3\t\t\n")
    assert sorted(map(tuple, read_truth(spark, [str(tmp_path)]).collect())) == [("u1", "x", "7"), ("u2", "y, z", "9"), ("u3", None, None)]


def test_running_sums_and_quantiles_of_odd_groups(spark):
    data = [(k, v, i) for i, (k, v) in enumerate([("a", 3), ("a", None), ("a", 1), (None, 5), (None, 2), ("b", 4)] * 50)]
    df = spark.createDataFrame(data, "k string, v long, i long")
    got = {r.i: (r.n, r.s) for r in prefix.running(df, ["k"], [F.col("i")], {"n": F.lit(1), "s": "v"}).collect()}
    seen = {}
    for k, v, i in data:
        n, s = seen.get(k, (0, 0))
        seen[k] = (n + 1, s + (v or 0))
        assert got[i] == seen[k]
    assert prefix.numbered(df.limit(0), ["k"], [F.col("i")], "n").count() == 0
    q = {r.k: (r.n, r.q5, r.q9) for r in quantiles.quantiles_higher(df, ["k"], "v", {"q5": 0.5, "q9": 0.9}).collect()}
    assert q == {"a": (100, 3, 3), None: (100, 5, 5), "b": (50, 4, 4)}


def test_learning_variants(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    y = x @ rng.normal(size=(6, 2)) @ rng.normal(size=(2, 5))
    data = spark.createDataFrame([("h", i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "host string, event_id long, x array<double>, y array<double>")
    u, v = variants.alternating_least_squares(data.select("x", "y"), rank=2, alpha=1e-6, rounds=30)
    assert np.abs(x @ u @ v - y).max() < 1e-3
    losses = variants.fit_lowrank(data.select("x", "y"), epochs=30)[2]
    assert losses[-1] < losses[0] / 2
    far = spark.createDataFrame([("h", 0, 0.0, 0.0), ("h", 1, 9.0, 0.0)], "host string, event_id long, a double, b double")
    near = spark.createDataFrame([("h", i, float(p), float(q)) for i, (p, q) in enumerate(rng.normal(size=(500, 2)))], "host string, event_id long, a double, b double")
    got = {r.event_id: r for r in variants.mahalanobis(far, ["a", "b"], near).collect()}
    assert got[0].distance < 1 < 7 < got[1].distance and got[1].top == "a" and sum(got[1].parts) == pytest.approx(got[1].distance ** 2)
