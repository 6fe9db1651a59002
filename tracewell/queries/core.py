"""Registered queries that apply an operator to the audit tables; their check is a SQL text of its own (tracewell/plans)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import node_rules, policies
from tracewell.operators import alerting, android, attributes, details, evaluation, flow, nodes, profiles, vectors, windows
from tracewell.operators import relational as rel
from tracewell.operators import thresholds
from tracewell.sources.audit import BY_ACTION, Audit
from tracewell.sources.staging import stage
from tracewell.streaming import folds

KS = [100, 200, 500, 1000, 1500, 3000]
BY_KINDS = ["action", "src_kind", "dst_kind"]
_HOST = ["host"]


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _ranked_nodes(a: Audit) -> DataFrame:
    return evaluation.rank_nodes(a.node_scores, a.truth, _HOST)


def _suppressed(a: Audit) -> DataFrame:
    return alerting.suppressed(a.history.where("split = 'test'"), a.history.where("split <> 'test'"), a.thresholds, BY_ACTION, least=1, margin=2000.0)


def _gated(a: Audit) -> DataFrame:
    return alerting.update_gate(a.test, a.thresholds, BY_ACTION, rate=1 / 1000.0)


_QS = [0.9, 0.95, 0.99, 0.995, 0.999]


def _fbeta(a: Audit) -> DataFrame:
    from tracewell.operators.quantiles import quantiles_higher

    benign = a.labelled.where("split = 'validation' AND label = 0")
    fitted = quantiles_higher(benign, _HOST, "score", {f"q{i}": q for i, q in enumerate(_QS)})
    rows = F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("thr")) for i, q in enumerate(_QS)))
    return evaluation.fbeta_search(a.labelled_test, fitted.select("host", F.explode(rows).alias("c")).select("host", "c.*"), _HOST)


OPERATORS: dict[str, Callable[[Audit], DataFrame]] = {
    # evaluation
    "label_distribution": lambda a: a.labelled.groupBy("host", "split", "label").agg(F.count("*").alias("n")),
    "event_confusion": lambda a: rounded(evaluation.event_confusion(a.judged, _HOST), precision=9, recall=9, fpr=9),
    "node_confusion": lambda a: rounded(evaluation.node_confusion(a.judged, a.truth, _HOST), precision=9, recall=9),
    "process_confusion": lambda a: rounded(evaluation.actor_confusion(a.judged, _HOST), precision=9, recall=9),
    "attack_window_metrics": lambda a: rounded(evaluation.window_metrics(a.alerts, a.windows), seconds_to_detect=6),
    "average_precision": lambda a: rounded(evaluation.average_precision(a.labelled_test, _HOST), average_precision=9),
    "roc_auc": lambda a: rounded(evaluation.roc_auc(a.labelled_test, _HOST), auc=9),
    "recall_at_k": lambda a: rounded(evaluation.recall_at_k(a.labelled_test, _HOST, KS), recall=9),
    "topk_precision": lambda a: rounded(evaluation.topk_precision(_ranked_nodes(a), _HOST, KS), precision=9),
    "node_topk_sweep": lambda a: rounded(evaluation.topk_sweep(_ranked_nodes(a), _HOST, KS), precision=9, recall=9),
    "budget_tail_metrics": lambda a: rounded(evaluation.budget_tail(a.labelled_test, _HOST, [10, 100, 1000]), precision=9),
    "categorical_lift": lambda a: rounded(
        evaluation.categorical_lift(a.alerts, {"action": F.col("action"), "src_kind": F.col("src_kind"), "dst_kind": F.col("dst_kind"), "type_pair": F.concat("src_kind", F.lit("->"), "dst_kind")}), fp_per_tp=9
    ),
    "numeric_fp_tp_summary": lambda a: rounded(
        evaluation.numeric_summary(alerting.with_threshold(flow.labelled(a.placed, a.truth).where("split = 'test'"), a.thresholds, BY_ACTION).where("score >= thr"), {"score": F.col("score"), "margin": F.col("score") - F.col("thr"), "stream_pos": F.col("stream_pos")}),
        fp_mean=4, tp_mean=4, fp_p50=4, fp_p90=4, tp_p50=4, tp_p99=4,
    ),
    "component_audit": lambda a: rounded(evaluation.component_audit(a.judged, _HOST, {"score": F.col("score"), "margin": F.col("score") - F.col("thr")}, (100, 1000)), gap=4),
    "label_group_summary": lambda a: rounded(evaluation.label_summary(a.labelled, ["split", "label"]), mean_score=4, std_score=4),
    "alert_delay_metrics": lambda a: rounded(_delay(a), mean_delay=4, median_delay=4, p90_delay=4),
    "event_alert_metrics": lambda a: rounded(a.alerts.groupBy("host").agg(F.count("*").alias("n_alerts"), F.count_if(F.expr("label = 2")).alias("malicious"), F.count_if(F.expr("label = 1")).alias("suspicious"), F.avg(F.expr("CAST(label > 0 AS DOUBLE)")).alias("tp_ratio")), tp_ratio=9),
    "fp_per_day": lambda a: rounded(evaluation.fp_per_day(a.test, a.alerts, _HOST), fp_per_day=9),
    "fbeta_threshold_search": lambda a: rounded(_fbeta(a), fbeta=9),
    "weight_grid_search": lambda a: evaluation.weight_grid(a.judged, _HOST, [(1.0, 0.0), (0.5, 0.5), (0.0, 1.0)], [F.col("score"), F.col("score") - F.col("thr")], 100),
    "prefix_alert_sweep": lambda a: evaluation.prefix_sweep(a.alerts, _HOST, KS),
    "node_coverage_eval": lambda a: rounded(evaluation.coverage_eval(a.alert_touch, a.truth), strict_precision=9, relaxed_precision=9, recall=9),
    "event_fp_groups": lambda a: rounded(evaluation.fp_groups(a.alerts, [*BY_KINDS, "label"]), precision=9, mean_score=4),
    "node_fp_groups": lambda a: evaluation.node_fp_groups(a.alert_touch, a.truth),
    "rank_nodes": lambda a: _ranked_nodes(a).select("host", "node_id", "node_score", "rk"),
    "top_events": lambda a: evaluation.top_events(a.test, _HOST, 1000).select("host", "event_id", "score", "rk"),
    "ranked_node_evidence": lambda a: _ranked_nodes(a).groupBy("host", F.when(F.col("rk") <= 100, "top").otherwise("rest").alias("band"), "kind").agg(F.count_if(F.expr("is_bad = 1")).alias("tp"), F.count_if(F.expr("is_bad = 0")).alias("negative"), F.max("node_score").alias("max_score")),
    # thresholds, suppression, policies, gates
    "endpoint_pair_counts": lambda a: alerting.history_counts(a.history.where("split <> 'test'"), ["src", "endpoint", "action"]),
    "endpoint_action_counts": lambda a: alerting.history_counts(a.history.where("split <> 'test'"), ["endpoint", "action"], "n"),
    "src_endpoint_counts": lambda a: alerting.history_counts(a.history.where("split <> 'test'"), ["src", "endpoint"], "n"),
    "endpoint_history": lambda a: alerting.with_history(a.history.where("split = 'test'"), a.history.where("split <> 'test'")).select("host", "event_id", *alerting.HISTORY_KEYS),
    "quantile_higher": lambda a: _quantiles(a),
    "score_summary": lambda a: rounded(alerting.score_summary(a.test, BY_ACTION, {"p99": 0.99, "p999": 0.999, "p9995": 0.9995, "p9999": 0.9999}, a.thresholds), mean_score=6, std_score=4),
    "histogram_quantiles": lambda a: rounded(alerting.histogram_quantiles(a.flow, BY_ACTION, {"q99": 0.99, "q50": 0.5}), q99=4, q50=4),
    "budget_threshold": lambda a: rounded(
        alerting.budget_thresholds(a.validation, _HOST, 100.0, 12000.0)
        .join(alerting.tail_rate_thresholds(a.validation, _HOST, 100.0, 12000.0), "host")
        .join(alerting.budget_thresholds(a.validation, _HOST, 1000.0, 1000000.0).select("host", F.col("thr").alias("thr_million")), "host"),
        thr_linear=4,
    ),
    "endpoint_suppression_summary": lambda a: rounded(alerting.suppression_summary(_suppressed(a), ["src", "endpoint", "action"]), mean_score=6),
    "suppression_eval": lambda a: alerting.suppression_eval(_suppressed(a), _HOST),
    "endpoint_suppression": lambda a: _suppressed(a).select("host", "event_id", "is_alert", "is_suppressed", "match_level"),
    "group_score_summary": lambda a: rounded(alerting.group_score_summary(a.validation, a.judged, BY_KINDS).withColumnRenamed("val_q", "val_q99"), precision=9, recall_share=9),
    "update_gate": lambda a: rounded(_gated(a).select("host", "event_id", "q"), q=9),
    "gate_stats_by_group": lambda a: rounded(alerting.gate_stats(_gated(a), BY_KINDS), mean_q=6, min_q=9, max_q=9, std_q=6),
    "group_threshold_sweep": lambda a: alerting.threshold_sweep(a.validation, a.labelled_test, BY_ACTION, [0.9, 0.99], [0.0, 500.0]),
    "alert_predicate": lambda a: alerting.alerts(a.test, a.thresholds, BY_ACTION).select("host", "event_id", "score", F.col("thr").alias("threshold")),
    "first_alert_per_node": lambda a: _first_alerts(a),
    # scans, projections, joins, sets
    "node_lookup": lambda a: rel.node_lookup(a.nodes),
    "scan_events_by_days": lambda a: rel.in_ranges(a.events, [("1999-03-01 05:00:00", "1999-03-11 05:00:00")]).select("host", "event_id", "ts_us", "src_id", "dst_id", "action"),
    "scan_events_multi_day": lambda a: rel.in_ranges(a.events, [("1998-02-01 05:00:00", "1998-02-03 05:00:00"), ("1999-07-04 04:00:00", "1999-07-06 04:00:00"), ("2001-01-02 05:00:00", "2001-01-05 05:00:00")]).select("host", "event_id", "ts_us", "action"),
    "bounded_scan": lambda a: rel.first_events(a.events, 1000).select("host", "event_id", "ts_us", "action"),
    "split_event_counts": lambda a: rel.split_counts(a.events, a.actions, ["split"]),
    "ten_action_filter": lambda a: rel.action_filter_report(a.events, a.actions, _HOST),
    "information_flow": lambda a: a.flow.select("host", "event_id", "info_src", "info_dst", "src_kind", "dst_kind", rel.mapped("action", rel.RELATIONS, "other").alias("relation")),
    "action_family": lambda a: a.events.groupBy("action").agg(F.count("*").alias("n")).withColumn("family", rel.mapped("action", rel.FAMILIES, "other")),
    "resolved_events_only": lambda a: rel.resolution_report(a.events, a.nodes, _HOST),
    "netflow_message": lambda a: rel.messages(a.nodes),
    "event_text": lambda a: rel.event_texts(a.flow, a.nodes),
    "residual_sentence": lambda a: rel.with_words(a.flow, rel.node_words(a.nodes)).select("host", "event_id", F.concat_ws(" ", "src_tokens", F.lower("action"), "dst_tokens").alias("sentence")),
    "suppression_candidate": lambda a: a.flow.select("host", "event_id", F.expr("action = 'EVENT_WRITE' AND src_kind = 'process' AND dst_kind = 'netflow'").alias("write_out"), F.expr("action = 'EVENT_READ' AND src_kind = 'netflow' AND dst_kind = 'process'").alias("read_in")),
    "alert_policy": lambda a: _policies(a).select("host", "event_id", "policy", "decision", "priority", "is_final"),
    "label_normalize": lambda a: rel.label_names(a.labelled.select("event_id", rel.mapped("label", {2: " Malicious", 1: "SUSPICIOUS "}, "benign").alias("raw"))),
    "alert_features": lambda a: rounded(rel.alert_features(a.alerts, a.nodes), margin=6),
    "enrich_events": lambda a: rel.enriched(a.events, a.nodes),
    "used_nodes": lambda a: a.nodes.join(rel.endpoints(a.flow), "node_id", "left_semi"),
    "missing_node_check": lambda a: rel.missing_nodes(a.events, a.nodes),
    "alert_event_labels": lambda a: rel.alert_labels(a.alerts, a.labelled),
    "alert_node_labels": lambda a: rel.node_labels(a.alert_touch, a.truth),
    "attack_window_join": lambda a: rel.in_windows(a.flow, a.windows).select("name", "host", "event_id", "ts_us"),
    "align_structured": lambda a: rel.aligned(a.test, a.labelled, _HOST),
    "remap_node_ids": lambda a: rel.remapped(a.flow, rel.compact_ids(a.touch, _HOST), _HOST).select("host", "event_id", "src_compact", "dst_compact"),
    "tail_surprisal": lambda a: rounded(rel.tail(a.flow, BY_ACTION, "split = 'validation'", "split = 'test'").select("host", "event_id", "surprisal"), surprisal=9),
    "conformal_pvalue": lambda a: rounded(rel.tail(a.flow, BY_ACTION, "split = 'validation'", "split = 'test'").select("host", "event_id", "p_value"), p_value=9),
    "endpoint_union": lambda a: rel.endpoints(a.flow),
    "split_set_algebra": lambda a: rel.split_algebra(a.touch),
    "gt_union": lambda a: a.truth.where("node_id < 1000000").select("uuid").union(a.truth.where("node_id % 2 = 0").select("uuid")).distinct(),
    "process_disjoint_split": lambda a: rel.held_out_owners(a.flow.where("split = 'train'"), _HOST, 0.1, "s").groupBy("host", "part").agg(F.count("*").alias("n_events"), F.count_distinct("actor_id").alias("n_owners")),
    "day_splits": lambda a: a.events.groupBy("split", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us")),
    "balanced_sample": lambda a: rel.first_by_group(a.placed, ["host", "object_kind"], 50, flow.order()).select("host", rel.mapped("object_kind", {"file": "process-file", "netflow": "process-netflow"}, "process-process").alias("pair"), "event_id", "stream_pos"),
    "malicious_pair_audit": lambda a: rel.with_words(_both_bad(a), rel.node_words(a.nodes)).select("host", "event_id", "action", "src_tokens", "dst_tokens"),
    # windows by node and edge
    "edge_novelty": lambda a: rounded(windows.edge_novelty(alerting.with_threshold(a.flow, a.thresholds, BY_ACTION), rel.mapped("action", rel.FAMILIES, "other")).select("host", "event_id", "excess"), excess=6),
    "recent_distinct_peers": lambda a: windows.recent(a.touch_placed, 2592000.0).select("host", "stream_pos", "node_id", "recent_peers"),
    "recent_chain_diversity": lambda a: windows.recent(a.touch_placed, 2592000.0).select("host", "stream_pos", "node_id", "kinds", "actions", "transitions"),
    "chain_transition_rarity": lambda a: rounded(windows.chain_profile(a.flow, "split = 'train'", "split = 'test'"), **dict.fromkeys(_CHAIN, 6)),
    "time_gaps": lambda a: rounded(windows.time_gaps(a.placed), global_gap=6, src_gap=6, edge_gap=6),
    "decayed_max": lambda a: rounded(windows.decayed_max(a.touch_placed, 31536000.0, 788918400000000).select("host", "stream_pos", "node_id", "decayed"), decayed=4),
    "state_asof": lambda a: rounded(windows.state_asof(a.touch_placed).select("host", "stream_pos", "node_id", "last_score", "last_us"), last_score=6),
    "node_pool_checkpoints": lambda a: rounded(windows.pool_checkpoints(a.touch_placed.where("split = 'test'"), 1000), best_score=4),
    "topm_per_node": lambda a: windows.top_per_node(a.touch.where("split = 'test'"), 32).select("host", "node_id", "event_id", "score", "r"),
    "node_pool": lambda a: rounded(windows.node_pool(alerting.with_threshold(a.touch.where("split = 'test'"), a.thresholds, BY_ACTION).withColumn("residual", F.greatest(F.col("score") - F.col("thr"), F.lit(0.0)))), **dict.fromkeys(["mass", "residual_mass", *windows.POOL_FORMULAS], 4)),
    # counts of training data, rarity
    "split_node_overlap": lambda a: profiles.split_overlap(a.touch),
    "node_mixing": lambda a: rounded(profiles.node_mixing(a.touch), action_entropy=6),
    "split_mixing_summary": lambda a: rounded(profiles.nearest_rank_summary(a.touch, ["split"], {"p50": 0.5, "p90": 0.9}), low_support=9),
    "token_frequency": lambda a: profiles.vocabulary(_tokens(a, "train")),
    "frozen_vocab": lambda a: profiles.frozen(_tokens(a, "train")),
    "unk_rates": lambda a: rounded(profiles.unknown_rates(_tokens(a), profiles.frozen(_tokens(a, "train")), ["host", "split"]), unknown_rate=9),
    "token_coverage": lambda a: profiles.token_coverage(a.touch, _node_tokens(a), profiles.counts(_tokens(a, "train"), ["token"])),
    "conditional_nll_counts": lambda a: rounded(profiles.conditional_nll(_train(a), a.test), action_nll=9, dst_kind_nll=9),
    "field_context_nll": lambda a: rounded(profiles.field_nll(_train(a), a.test, _node_tokens(a)), dst_field_nll=6, worst=6),
    "edge_familiarity": lambda a: rounded(profiles.edge_surprise(_train(a), a.test), surprise=9),
    "bucket_rarity": lambda a: rounded(profiles.token_rarity(_tokens(a, "train"), _tokens(a, "test")), mean_rarity=6, max_rarity=6, top3_rarity=6),
    "profile_rarity": lambda a: rounded(profiles.profile_rarity(_train(a), a.test), **dict.fromkeys([*profiles.PROFILES, "src_self_rarity", "dst_self_rarity", "endpoint_self_rarity"], 9)),
    "process_semantic_audit": lambda a: profiles.role_audit(a.flow, rel.node_words(a.nodes)),
    "collision_audit": lambda a: profiles.collisions(a.nodes, rel.node_words(a.nodes), a.touch.where("split = 'train'")),
    "temporal_count_score": lambda a: rounded(profiles.temporal_count_score(_train(a), a.test), score=6),
    "latent_dim_from_vocab": lambda a: profiles.latent_dimensions(profiles.counts(_tokens(a, "train"), ["token"])),
    # attributes
    "path_tokens": lambda a: a.nodes.where("path IS NOT NULL").select("path").distinct().select("path", F.array_join(attributes.path_tokens(F.col("path")), " ").alias("tokens")),
    "value_signature": lambda a: a.nodes.select(F.explode(F.array("dst_addr", "dst_port", "path", "cmd")).alias("v")).where("v IS NOT NULL").distinct().withColumn("signature", attributes.value_signature(F.col("v"))),
    "netflow_tokens": lambda a: attributes.netflow_tokens(a.nodes),
    "ip_scope": lambda a: a.nodes.where("kind = 'netflow'").select("dst_addr", "dst_port").distinct().withColumns({"scope": attributes.address_scope(F.col("dst_addr")), "port_bucket": attributes.port_bucket(F.col("dst_port"))}),
    "process_tokens": lambda a: attributes.process_tokens(a.nodes),
    "hash_sketch": lambda a: rounded(vectors.hash_sketch(_node_tokens(a)), value=9),
    # more thresholds and summaries
    "group_thresholds": lambda a: thresholds.fit_thresholds(thresholds.scored_events(a.flow).where("split = 'validation'")),
    "resolve_group_threshold": lambda a: rounded(thresholds.resolved_events(a.flow).select("host", "event_id", "threshold", "threshold_level"), threshold=6),
    "node_coverage": lambda a: thresholds.covered_nodes(thresholds.resolved_events(a.flow).where("score >= threshold")),
    "target_case_thresholds": lambda a: _case_thresholds(a),
    "target_case_summary": lambda a: rounded(_resolved_labelled(a).groupBy("target_case").agg(F.count("*").alias("n"), F.count_if(F.expr("score >= threshold")).alias("n_alerts"), F.count_if(F.expr("score >= threshold AND label > 0")).alias("tp"), F.count_if(F.expr("score >= threshold AND label = 0")).alias("fp"), F.avg("threshold").alias("mean_threshold")), mean_threshold=4),
    "policy_group_summary": lambda a: rounded(_decided(a).groupBy(*BY_KINDS).agg(F.count("*").alias("n_events"), F.count_if(F.expr("score >= threshold")).alias("n_alerts"), F.count_if(F.expr("score >= threshold AND decision = 'evidence'")).alias("n_evidence"), F.count_if(F.expr("score >= threshold AND decision = 'high'")).alias("n_high"), F.avg("threshold").alias("mean_threshold")), mean_threshold=4),
    "demoted_group_summary": lambda a: _decided(a).where("score >= threshold AND decision = 'evidence'").groupBy(*BY_KINDS, "target_case").agg(F.count("*").alias("n_evidence"), F.max("score").alias("max_score")),
    "robust_stats": lambda a: rounded(alerting.robust_stats(a.labelled.where("split = 'validation' AND label = 0"), BY_ACTION, {"q95": 0.95, "q999": 0.999}), median=6, mad=6, q95=6, q999=6),
    "upper_z": lambda a: rounded(alerting.upper_z(a.test, alerting.robust_stats(a.validation, BY_ACTION, {}), BY_ACTION).select("host", "event_id", "z"), z=6),
    "quantile_knots": lambda a: rounded(alerting.quantile_knots(a.validation, BY_ACTION), surprise=9),
    "episode_alert_metrics": lambda a: evaluation.episode_metrics(a.alerts, a.truth, a.windows, _HOST),
    "score_drift": lambda a: rounded(evaluation.score_drift(a.validation, a.labelled_test, BY_ACTION, ["host", "label"]), mean_drift=6),
    "attack_plus_benign_reservoir": lambda a: a.labelled_test.where("label = 2").select("host", "event_id", "label").unionByName(rel.reservoir(a.labelled_test.where("label = 0"), _HOST, 200, "s").select("host", "event_id", "label")),
    "train_reservoir": lambda a: rel.reservoir(_train(a), _HOST, 500, "t").select("host", "event_id"),
    "gt_resolve": lambda a: rel.resolved_truth(_truth_files(a), a.nodes),
    # node ranking
    "node_score": lambda a: rounded(nodes.scores(_evidence(a)).select("host", "node_id", "node_score"), node_score=4),
    "node_features": lambda a: rounded(nodes.features(_evidence(a)).select("host", "node_id", "kind", "max_score", "n_high", "soft", "n", "n_src", "n_dst", "peers", "actions", "peer_kinds", "mean_score", "stability", "chain"), soft=4, mean_score=4, stability=6, chain=9),
    "node_rerank": lambda a: rounded(nodes.reranked(nodes.ranked(_evidence(a))).select("host", "node_id", "reranked"), reranked=6),
    "activity_normalized_chain": lambda a: rounded(nodes.chain_boost(nodes.ranked(_evidence(a))).select("host", "node_id", "rk", "boosted"), boosted=4),
    "closure_score": lambda a: rounded(nodes.closure(nodes.ranked(_evidence(a))).select("host", "node_id", "rk", "closure"), closure=4),
    "evidence_band_gate": lambda a: rounded(nodes.evidence_gate(nodes.ranked(_evidence(a))).select("host", "node_id", "rk", "families", "gated"), gated=4),
    "mid_rank_gate": lambda a: rounded(nodes.mid_rank_gate(nodes.ranked(_evidence(a))).select("host", "node_id", "rk", "gated"), gated=4),
    "local_closure": lambda a: rounded(nodes.local_closure(nodes.ranked(_evidence(a))).select("host", "node_id", "rk", "core", "passes"), core=6),
    "freebsd_node_semantics": lambda a: _classes(a, "freebsd"),
    "linux_node_semantics": lambda a: _classes(a, "linux"),
    "android_node_semantics": lambda a: _classes(a, "android"),
    "freebsd_file_details": lambda a: details.file_details(_all_classes(a), "freebsd"),
    "linux_file_details": lambda a: details.file_details(_all_classes(a), "linux"),
    "freebsd_process_details": lambda a: details.process_details(a.nodes, _all_classes(a), "freebsd"),
    "linux_process_details": lambda a: details.process_details(a.nodes, _all_classes(a), "linux"),
    "freebsd_netflow_tokens": lambda a: details.netflow_roles(a.nodes, "freebsd").withColumn("tokens", F.array_join("tokens", " ")),
    "linux_netflow_tokens": lambda a: details.netflow_roles(a.nodes, "linux").withColumn("tokens", F.array_join("tokens", " ")),
    "natural_sentence": lambda a: _natural_sentences(a, "linux"),
    "android_file_details": lambda a: android.file_details(_phone_classes(a)),
    "android_file_details_legacy": lambda a: android.file_details(_phone_classes(a), "legacy"),
    "android_process_details": lambda a: android.process_details(_phone(a)),
    "android_process_details_legacy": lambda a: android.process_details(_phone(a), "legacy"),
    "android_sentence": lambda a: android.sentences(a.flow, android.natural_tokens(_phone(a), _phone_classes(a))),
    "semantic_profile_route": lambda a: attributes.routed(a.events, {"h0%": "freebsd", "h1%": "linux", "h2%": "android"}),
    "node_roles": lambda a: attributes.head_roles(attributes.summaries(a.nodes), 2),
    "coarse_raw_roles": lambda a: attributes.coarse_and_raw(attributes.summaries(a.nodes)),
    "flow_gates": lambda a: rounded(_gates(a), gate_lambda=9, gate_rho=9),
    # flow and node history
    "event_label": lambda a: a.labelled.select("host", "event_id", "label"),
    "stream_pos": lambda a: a.placed.select("host", "event_id", "ts_us", "stream_pos"),
    "label_free_projection": lambda a: a.placed.select("host", "stream_pos", "event_id", "ts_us", "action", "info_src", "info_dst", "src_kind", "dst_kind"),
    "actor_normalize": lambda a: flow.actor_object(a.events, a.nodes).select("host", "event_id", "actor_id", "object_id", "object_kind", "object_addr", "swapped"),
    "node_counts_before": lambda a: flow.counts_before(a.touch_placed).select("host", "stream_pos", "node_id", "n_before", "src_before", "dst_before"),
    "has_state_before": lambda a: flow.active(a.touch_placed).select("host", "stream_pos", "node_id", "is_active"),
    "target_case": lambda a: a.cased.select("host", "event_id", "target_case", "src_active", "dst_active"),
    "endpoint_signature": lambda a: a.nodes.select("node_id", flow.endpoint_signature(a.nodes.columns).alias("signature")),
}


def _case_thresholds(a: Audit) -> DataFrame:
    """The 0.99 quantile of each target case with 100 rows at least, else that of all."""
    case = a.cased.where("split = 'validation'")
    own, whole = alerting.group_quantile_thresholds(case, ["target_case"]), alerting.group_quantile_thresholds(case, [])
    return own.join(F.broadcast(whole.select(F.col("thr").alias("__all")))).select("target_case", "n", F.when(F.col("n") >= thresholds.LEAST_ROWS, F.col("thr")).otherwise(F.col("__all")).alias("thr"))


def _resolved(a: Audit) -> DataFrame:
    cased = stage(a.cased.where("split <> 'train'"), "cased")
    return thresholds.resolve(cased.where("split = 'test'"), stage(thresholds.fit_thresholds(cased.where("split = 'validation'")), "thresholds"))


def _resolved_labelled(a: Audit) -> DataFrame:
    return _resolved(a).join(a.labelled.select("host", "event_id", "label"), ["host", "event_id"])


def _decided(a: Audit, policy: str = "theia_v1") -> DataFrame:
    rules, defaults = policies.tables(a.events.sparkSession)
    return alerting.decided(_resolved(a), rules.where(F.col("policy") == policy), defaults.where(F.col("policy") == policy))


def _truth_files(a: Audit) -> DataFrame:
    """Truth as files have it: some rows with an index of their own, which is only used where the uuid is unknown."""
    odd = a.truth.sparkSession.createDataFrame([("missing", "42"), ("bad", "x1")], "uuid string, old_index string")
    return a.truth.select("uuid", (F.col("node_id") + 7).cast("string").alias("old_index")).unionByName(odd)


def _all_classes(a: Audit) -> DataFrame:
    return attributes.node_classes(a.nodes, *node_rules.tables(a.nodes.sparkSession))


#: where a phone has what lies in these folders, and how the names of its packages start
PHONE_FOLDERS = (("/tmp/", "/data/local/tmp/"), ("/etc/", "/system/etc/"), ("/var/log/", "/data/system/dropbox/"), ("/usr/lib//", "/data/data/com.shop/databases/"), ("/home/u/", "/storage/emulated/0/DCIM/"))
PHONE_PACKAGES = ("com.android.providers.", "com.google.Apps.", "net.tools.", "")


def _phone(a: Audit) -> DataFrame:
    """The nodes laid out as on a phone: its folders, and command lines that are names of packages, some with a part after a colon."""
    path = F.col("path")
    for here, there in PHONE_FOLDERS:
        path = F.when(F.startswith("path", F.lit(here)), F.concat(F.lit(there), F.substr("path", F.lit(len(here) + 1)))).otherwise(path)
    start = F.get(F.array(*map(F.lit, PHONE_PACKAGES)), (F.col("node_id") % len(PHONE_PACKAGES)).cast("int"))
    return a.nodes.withColumns({
        "path": F.when(F.col("kind") == "file", path).otherwise(F.col("path")),
        "cmd": F.when(F.col("kind") == "process", F.concat(start, F.substring_index("cmd", " ", 1), F.when(F.col("node_id") % 3 == 0, ":remote").otherwise(""))),
    })


def _phone_classes(a: Audit) -> DataFrame:
    return attributes.node_classes(_phone(a), *node_rules.tables(a.nodes.sparkSession))


def _natural_sentences(a: Audit, system: str) -> DataFrame:
    """host, event_id and the sentence of both ends' kind, class and detail around the action."""
    words = details.natural_tokens(a.nodes, _all_classes(a), system).select("node_id", "kind", F.array_join("tokens", " ").alias("tokens"))
    return rel.with_words(a.flow, words).select("host", "event_id", F.concat_ws(" ", "src_tokens", F.lower("action"), "dst_tokens").alias("sentence"))


def _classes(a: Audit, system: str) -> DataFrame:
    rules, defaults = node_rules.tables(a.nodes.sparkSession)
    return attributes.node_classes(a.nodes, rules.where(F.col("system") == system), defaults.where(F.col("system") == system)).drop("system")


def _gates(a: Audit) -> DataFrame:
    """An event's gates: its action's, scaled by its source's kind, as the folds apply them."""
    scale = rel.mapped("src_kind", folds.SCALE, folds.SCALE["unknown"])
    return a.flow.select("host", "event_id", (rel.mapped("action", folds.LAMBDA, None) * scale).alias("gate_lambda"), (rel.mapped("action", folds.RHO, None) * scale).alias("gate_rho"))


def _policies(a: Audit) -> DataFrame:
    return alerting.decided(a.judged, *policies.tables(a.events.sparkSession), alert="score >= thr")


def _evidence(a: Audit) -> DataFrame:
    return nodes.evidence(alerting.with_threshold(a.touch.where("split = 'test'"), a.thresholds, BY_ACTION))


def _train(a: Audit) -> DataFrame:
    return a.flow.where("split = 'train'")


def _node_tokens(a: Audit) -> DataFrame:
    return profiles.node_tokens(rel.node_words(a.nodes))


def _tokens(a: Audit, split: str | None = None) -> DataFrame:
    return profiles.event_tokens(a.flow.where(F.col("split") == split) if split else a.flow, _node_tokens(a))


def _both_bad(a: Audit) -> DataFrame:
    bad = a.truth.select("node_id").distinct()
    return a.flow.join(bad.withColumnRenamed("node_id", "info_src"), "info_src", "left_semi").join(bad.withColumnRenamed("node_id", "info_dst"), "info_dst", "left_semi")


def _delay(a: Audit) -> DataFrame:
    scored = flow.labelled(a.placed, a.truth).where("split = 'test'")
    return evaluation.alert_delay(scored, alerting.alerts(scored, a.thresholds, BY_ACTION), _HOST)


def _quantiles(a: Audit) -> DataFrame:
    from tracewell.operators.quantiles import quantiles_higher

    return quantiles_higher(a.flow, ["host", "action"], "score", {"q90": 0.9, "q99": 0.99, "q999": 0.999}).select("host", "action", "q90", "q99", "q999")


def _first_alerts(a: Audit) -> DataFrame:
    scored = flow.labelled(a.placed, a.truth).where("split = 'test'")
    touched = alerting.alert_touches(alerting.alerts(scored, a.thresholds, BY_ACTION))
    first = F.min_by(F.struct("event_id", "stream_pos", "score"), "stream_pos")
    return touched.groupBy("host", "node_id").agg(first.alias("f")).select("host", "node_id", "f.*")


#: over vectors: each with the first of its ten, and with the class that it is labelled with as its group
VECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "distance": lambda v: rounded(_pairs(v).select("vec_id", vectors.cosine_distance("p", "y").alias("cosine_distance"), vectors.mse("p", "y").alias("mse")), cosine_distance=5, mse=6),
    "action_residual_variance": lambda v: rounded(vectors.residual_variance(v.withColumnRenamed("label", "action_id"), "action_id", F.col("embedding").cast("array<double>"), least=30), variance=8),
    "residual_score": lambda v: rounded(vectors.residual_scores(_pairs(v)), legacy=6, raw_mse=5, var_calibrated=4),
    "score_targets": lambda v: rounded(vectors.targets(_pairs(v)), weighted_target=6, pair_target=6, event_target=6, mixture_target=6),
    "top_residual_dims": lambda v: rounded(vectors.top_residuals(_pairs(v)), residual=6),
}


def _pairs(v: DataFrame) -> DataFrame:
    return vectors.paired(v, F.col("vec_id") - F.col("vec_id") % 10)


def _registered(f: Callable[[Audit], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Audit.of(spark, sf_dir))


_CHAIN = ("pair_rarity", "edge_rarity", "role_rarity", "max_rarity", "mean_rarity", "discrepancy", "chain_score")
QUERIES = {name: _registered(f) for name, f in OPERATORS.items()} | {name: (lambda f: lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))(f) for name, f in VECTORS.items()}
