"""Thresholds, alert summaries and evaluation. Labels are only joined here, after scoring."""

from __future__ import annotations


def ranks(table: str, key: str, value: str) -> str:
    """Rows with their 0-based rank of ``value`` and number of rows for each key."""
    return f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS r, count(*) OVER (PARTITION BY {key}) AS n FROM {table}"


def higher(value: str, q: float, r: str = "r", n: str = "n") -> str:
    """The quantile that is the value of rank ceil(q * (n - 1))."""
    return f"max(CASE WHEN {r} = ceil({q} * ({n} - 1)) THEN {value} END)"


def rates(tp: str, fp: str, fn: str) -> str:
    return f"round(coalesce({tp} / nullif(CAST({tp} + {fp} AS DOUBLE), 0), 0), 9) AS precision, round(coalesce({tp} / nullif(CAST({tp} + {fn} AS DOUBLE), 0), 0), 9) AS recall"


COMMON: dict[str, str] = {
    "validation_levels": """
SELECT 'case_action_types' AS level, target_case, action, src_kind, dst_kind, score FROM cased WHERE split = 'validation'
UNION ALL SELECT 'case_action', target_case, action, NULL, NULL, score FROM cased WHERE split = 'validation'
UNION ALL SELECT 'case_types', target_case, NULL, src_kind, dst_kind, score FROM cased WHERE split = 'validation'
UNION ALL SELECT 'case', target_case, NULL, NULL, NULL, score FROM cased WHERE split = 'validation'
UNION ALL SELECT 'global', NULL, NULL, NULL, NULL, score FROM cased WHERE split = 'validation'""",
    "level_ranked": ranks("validation_levels", "level, target_case, action, src_kind, dst_kind", "score"),
    "group_thr": f"""
SELECT level, target_case, action, src_kind, dst_kind, max(n) AS n, {higher('score', 0.99)} AS thr, {higher('score', 0.9999)} AS extreme, max(score) AS vmax, max(n) >= 100 AS eligible FROM level_ranked GROUP BY level, target_case, action, src_kind, dst_kind""",
    "resolved": """
SELECT c.host, c.event_id, c.action, c.src_kind, c.dst_kind, c.target_case, c.info_src, c.info_dst, c.stream_pos, c.ts_us, c.score,
  CASE WHEN g.n IS NULL THEN gl.extreme WHEN g.n >= 100 THEN g.thr
    ELSE greatest(g.vmax + 0.25, coalesce(CASE WHEN ca.eligible THEN ca.thr END, CASE WHEN ct.eligible THEN ct.thr END, CASE WHEN cc.eligible THEN cc.thr END, gl.thr), gl.thr) END AS threshold,
  CASE WHEN g.n IS NULL THEN 'global_extreme' WHEN g.n >= 100 THEN 'case_action_types' WHEN ca.eligible THEN 'case_action' WHEN ct.eligible THEN 'case_types' WHEN cc.eligible THEN 'case' ELSE 'global' END AS threshold_level
FROM cased c
LEFT JOIN group_thr g ON g.level = 'case_action_types' AND g.target_case = c.target_case AND g.action = c.action AND g.src_kind = c.src_kind AND g.dst_kind = c.dst_kind
LEFT JOIN group_thr ca ON ca.level = 'case_action' AND ca.target_case = c.target_case AND ca.action = c.action
LEFT JOIN group_thr ct ON ct.level = 'case_types' AND ct.target_case = c.target_case AND ct.src_kind = c.src_kind AND ct.dst_kind = c.dst_kind
LEFT JOIN group_thr cc ON cc.level = 'case' AND cc.target_case = c.target_case
CROSS JOIN (SELECT thr, extreme FROM group_thr WHERE level = 'global') gl WHERE c.split = 'test'""",
    "group_alerts": "SELECT * FROM resolved WHERE score >= threshold",
    "pair_history": "SELECT src, endpoint, action, count(*) AS history_count FROM history WHERE split <> 'test' GROUP BY src, endpoint, action",
    "suppressed": """
SELECT h.*, t.thr, h.score >= t.thr AS is_alert, coalesce(p.history_count, 0) AS history_count, h.score >= t.thr AND coalesce(p.history_count, 0) >= 1 AND h.score < t.thr + 2000 AS is_suppressed
FROM history h JOIN action_thresholds t ON t.action = h.action LEFT JOIN pair_history p ON p.src = h.src AND p.endpoint = h.endpoint AND p.action = h.action WHERE h.split = 'test'""",
    "node_sets": """
SELECT t.host, t.node_id, max(CASE WHEN g.node_id IS NULL THEN 0 ELSE 1 END) AS positive, max(CASE WHEN t.label = 1 THEN 1 ELSE 0 END) AS suspect, max(CASE WHEN t.score >= t.thr THEN 1 ELSE 0 END) AS alerted
FROM (SELECT l.host, l.info_src AS node_id, l.label, l.score, a.thr FROM labeled l JOIN action_thresholds a ON a.action = l.action WHERE l.split = 'test'
  UNION ALL SELECT l.host, l.info_dst, l.label, l.score, a.thr FROM labeled l JOIN action_thresholds a ON a.action = l.action WHERE l.split = 'test') t
LEFT JOIN gt_nodes g ON g.node_id = t.node_id GROUP BY t.host, t.node_id""",
    "budgets": "SELECT 10 AS budget UNION ALL SELECT 100 UNION ALL SELECT 1000",
}

_CONF = "count_if(is_alert AND pos) AS tp, count_if(is_alert AND NOT pos) AS fp, count_if(NOT is_alert AND pos) AS fn, count_if(NOT is_alert AND NOT pos) AS tn"

TEXTS: dict[str, str] = {
    "group_thresholds": "SELECT level, target_case, action, src_kind, dst_kind, n, thr, extreme, vmax, eligible FROM group_thr",
    "resolve_group_threshold": "SELECT host, event_id, round(threshold, 6) AS threshold, threshold_level FROM resolved",
    "node_coverage": """
SELECT host, node_id, min_by(event_id, stream_pos) AS first_alert, max_by(event_id, stream_pos) AS last_alert, CAST(sum(as_src) AS BIGINT) AS n_src, CAST(sum(as_dst) AS BIGINT) AS n_dst, max(score) AS max_score FROM (
  SELECT host, info_src AS node_id, event_id, stream_pos, score, 1 AS as_src, CASE WHEN info_src = info_dst THEN 1 ELSE 0 END AS as_dst FROM group_alerts
  UNION ALL SELECT host, info_dst, event_id, stream_pos, score, 0, 1 FROM group_alerts WHERE info_src <> info_dst) t GROUP BY host, node_id""",
    "label_distribution": "SELECT host, split, label, count(*) AS n FROM labeled GROUP BY host, split, label",
    "endpoint_pair_counts": "SELECT src, endpoint, action, count(*) AS history_count FROM history WHERE split <> 'test' GROUP BY src, endpoint, action",
    "endpoint_action_counts": "SELECT endpoint, action, count(*) AS n FROM history WHERE split <> 'test' GROUP BY endpoint, action",
    "src_endpoint_counts": "SELECT src, endpoint, count(*) AS n FROM history WHERE split <> 'test' GROUP BY src, endpoint",
    "quantile_higher": f"SELECT host, action, {higher('score', 0.9)} AS q90, {higher('score', 0.99)} AS q99, {higher('score', 0.999)} AS q999 FROM ({ranks('flow', 'host, action', 'score')}) x GROUP BY host, action",
    "score_summary": f"""
SELECT x.action, max(x.n) AS n, min(score) AS min_score, round(avg(score), 6) AS mean_score, max(score) AS max_score, round(stddev_pop(score), 4) AS std_score, {higher('score', 0.99, n='x.n')} AS p99, {higher('score', 0.999, n='x.n')} AS p999, {higher('score', 0.9995, n='x.n')} AS p9995, {higher('score', 0.9999, n='x.n')} AS p9999,
  count_if(score >= t.thr) AS n_over FROM ({ranks("(SELECT * FROM flow WHERE split = 'test') f", 'action', 'score')}) x JOIN action_thresholds t ON t.action = x.action GROUP BY x.action""",
    "target_case_thresholds": """
SELECT c.target_case, c.n, CASE WHEN c.n >= 100 THEN c.thr ELSE g.thr END AS thr FROM (SELECT * FROM group_thr WHERE level = 'case') c CROSS JOIN (SELECT thr FROM group_thr WHERE level = 'global') g""",
    "histogram_quantiles": """
WITH b AS (SELECT action, least(19999, CAST(floor((score - lo) / (hi - lo) * 20000) AS BIGINT)) AS bin, count(*) AS n, min(lo) AS lo, min(hi) AS hi FROM (
  SELECT action, score, min(score) OVER (PARTITION BY action) AS lo, max(score) OVER (PARTITION BY action) AS hi FROM flow) x GROUP BY action, least(19999, CAST(floor((score - lo) / (hi - lo) * 20000) AS BIGINT))),
c AS (SELECT *, sum(n) OVER (PARTITION BY action ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY action) AS total FROM b)
SELECT action, CAST(max(total) AS BIGINT) AS total, round(min(CASE WHEN upto >= ceil(0.99 * total) THEN least(hi, lo + (bin + 1) * (hi - lo) / 20000) END), 4) AS q99,
  round(min(CASE WHEN upto >= ceil(0.5 * total) THEN least(hi, lo + (bin + 1) * (hi - lo) / 20000) END), 4) AS q50 FROM c GROUP BY action""",
    "budget_threshold": """
WITH r AS (SELECT host, score, row_number() OVER (PARTITION BY host ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY host) AS n FROM flow WHERE split = 'validation')
SELECT host, max(n) AS n, max(CASE WHEN r = greatest(1, least(n, /*spark bround*//*duck round_even*/(n * 100.0 / 12000, 0))) THEN score END) AS thr, round(percentile_cont(0.9916666666666667) WITHIN GROUP (ORDER BY score), 4) AS thr_linear,
  max(CASE WHEN r = greatest(1, least(n, /*spark bround*//*duck round_even*/(n * 1000.0 / 1000000, 0))) THEN score END) AS thr_million FROM r GROUP BY host""",
    "endpoint_suppression_summary": """
SELECT src, endpoint, action, count(*) AS n, count_if(is_alert) AS raw_alerts, count_if(is_suppressed) AS suppressed, count_if(is_alert AND NOT is_suppressed) AS final_alerts, max(score) AS max_score, round(avg(score), 6) AS mean_score FROM suppressed GROUP BY src, endpoint, action""",
    "suppression_eval": """
SELECT host, count_if(is_alert AND label > 0) AS tp_before, count_if(is_alert AND label = 0) AS fp_before, count_if(is_alert AND NOT is_suppressed AND label > 0) AS tp_after, count_if(is_alert AND NOT is_suppressed AND label = 0) AS fp_after,
  count_if(is_suppressed AND label > 0) AS tp_suppressed FROM suppressed GROUP BY host""",
    "endpoint_suppression": "SELECT host, event_id, is_alert, is_suppressed, CASE WHEN history_count >= 1 THEN 'src_endpoint_action' ELSE 'none' END AS match_level FROM suppressed",
    "group_score_summary": f"""
WITH v AS (SELECT action, src_kind, dst_kind, max(n) AS val_n, {higher('score', 0.99)} AS val_q99 FROM ({ranks("(SELECT * FROM flow WHERE split = 'validation') f", 'action, src_kind, dst_kind', 'score')}) x GROUP BY action, src_kind, dst_kind),
t AS (SELECT l.action, l.src_kind, l.dst_kind, count(*) AS test_n, count_if(l.score >= a.thr) AS n_alerts, count_if(l.score >= a.thr AND l.label > 0) AS tp, count_if(l.score >= a.thr AND l.label = 0) AS fp, count_if(l.label > 0) AS positives
  FROM labeled l JOIN action_thresholds a ON a.action = l.action WHERE l.split = 'test' GROUP BY l.action, l.src_kind, l.dst_kind)
SELECT coalesce(v.action, t.action) AS action, coalesce(v.src_kind, t.src_kind) AS src_kind, coalesce(v.dst_kind, t.dst_kind) AS dst_kind, val_n, val_q99, test_n, n_alerts, tp, fp, round(tp / nullif(CAST(n_alerts AS DOUBLE), 0), 9) AS precision,
  round(tp / nullif(CAST(positives AS DOUBLE), 0), 9) AS recall_share FROM v FULL OUTER JOIN t ON v.action = t.action AND v.src_kind = t.src_kind AND v.dst_kind = t.dst_kind""",
    "target_case_summary": """
SELECT r.target_case, count(*) AS n, count_if(r.score >= r.threshold) AS n_alerts, count_if(r.score >= r.threshold AND l.label > 0) AS tp, count_if(r.score >= r.threshold AND l.label = 0) AS fp, round(avg(r.threshold), 4) AS mean_threshold
FROM resolved r JOIN labeled l ON l.host = r.host AND l.event_id = r.event_id GROUP BY r.target_case""",
    "policy_group_summary": """
SELECT r.action, r.src_kind, r.dst_kind, count(*) AS n_events, count_if(r.score >= r.threshold) AS n_alerts, count_if(r.score >= r.threshold AND p.decision = 'evidence') AS n_evidence, count_if(r.score >= r.threshold AND p.decision = 'high') AS n_high,
  round(avg(r.threshold), 4) AS mean_threshold FROM resolved r LEFT JOIN (SELECT * FROM policy_rules WHERE policy = 'theia_v1') p ON p.action = r.action AND p.src_kind = r.src_kind AND p.dst_kind = r.dst_kind GROUP BY r.action, r.src_kind, r.dst_kind""",
    "update_gate": """
SELECT f.host, f.event_id, round(CASE WHEN f.score <= t.thr THEN 1.0 ELSE greatest(0.05, exp(-(f.score - t.thr) / 1000.0)) END, 9) AS q FROM flow f JOIN action_thresholds t ON t.action = f.action WHERE f.split = 'test'""",
    "gate_stats_by_group": """
SELECT action, src_kind, dst_kind, count(*) AS n, round(avg(q), 6) AS mean_q, round(min(q), 9) AS min_q, round(max(q), 9) AS max_q, round(coalesce(stddev_pop(q), 0), 6) AS std_q, count_if(q = 1.0) AS applied, count_if(q < 1.0) AS reduced FROM (
  SELECT f.action, f.src_kind, f.dst_kind, CASE WHEN f.score <= t.thr THEN CAST(1.0 AS DOUBLE) ELSE greatest(0.05, exp(-(f.score - t.thr) / 1000.0)) END AS q FROM flow f JOIN action_thresholds t ON t.action = f.action WHERE f.split = 'test') x GROUP BY action, src_kind, dst_kind""",
    "demoted_group_summary": """
SELECT a.action, a.src_kind, a.dst_kind, a.target_case, count(*) AS n_evidence, max(a.score) AS max_score FROM group_alerts a JOIN policy_rules p ON p.policy = 'theia_v1' AND p.decision = 'evidence' AND p.action = a.action AND p.src_kind = a.src_kind AND p.dst_kind = a.dst_kind
GROUP BY a.action, a.src_kind, a.dst_kind, a.target_case""",
    "node_coverage_eval": f"""
WITH n AS (SELECT t.host, t.node_id, max(CASE WHEN g.node_id IS NULL THEN 0 ELSE 1 END) AS bad, bool_and(t.label > 0) AS all_attack FROM alert_touch t LEFT JOIN gt_nodes g ON g.node_id = t.node_id GROUP BY t.host, t.node_id),
c AS (SELECT count_if(bad = 1) AS tp, count_if(bad = 0) AS strict_fp, count_if(bad = 0 AND all_attack) AS ignored, count_if(bad = 0 AND NOT all_attack) AS fp, (SELECT count(*) FROM gt_nodes) AS all_gt, count(DISTINCT CASE WHEN bad = 1 THEN node_id END) AS tp_nodes FROM n)
SELECT tp, strict_fp, ignored, fp, round(tp / CAST(tp + strict_fp AS DOUBLE), 9) AS strict_precision, round(tp / CAST(tp + fp AS DOUBLE), 9) AS relaxed_precision, round(tp_nodes / CAST(all_gt AS DOUBLE), 9) AS recall FROM c""",
    "event_fp_groups": """
SELECT action, src_kind, dst_kind, label, count(*) AS n, count_if(label > 0) AS tp, count_if(label = 0) AS fp, round(avg(CASE WHEN label > 0 THEN 1.0E0 ELSE 0.0E0 END), 9) AS precision, min(score) AS min_score, max(score) AS max_score, round(avg(score), 4) AS mean_score FROM alerts GROUP BY action, src_kind, dst_kind, label""",
    "node_fp_groups": """
SELECT kind, bad, count(*) AS n_nodes, CAST(sum(support) AS BIGINT) AS support, max(max_score) AS max_score FROM (
  SELECT t.host, t.node_id, max(t.kind) AS kind, max(CASE WHEN g.node_id IS NULL THEN 0 ELSE 1 END) AS bad, count(*) AS support, max(t.score) AS max_score FROM alert_touch t LEFT JOIN gt_nodes g ON g.node_id = t.node_id GROUP BY t.host, t.node_id) x GROUP BY kind, bad""",
    "event_confusion": f"""
WITH e AS (SELECT l.host, l.label, l.score >= a.thr AS is_alert FROM labeled l JOIN action_thresholds a ON a.action = l.action WHERE l.split = 'test'),
m AS (SELECT host, 'strict' AS mode, is_alert, label = 2 AS pos FROM e UNION ALL SELECT host, 'relaxed', is_alert, label = 2 FROM e WHERE label <> 1),
c AS (SELECT host, mode, {_CONF} FROM m GROUP BY host, mode) SELECT host, mode, tp, fp, fn, tn, {rates('tp', 'fp', 'fn')}, round(coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0), 9) AS fpr FROM c""",
    "node_confusion": f"""
WITH m AS (SELECT host, 'strict' AS mode, alerted = 1 AS is_alert, positive = 1 AS pos FROM node_sets UNION ALL SELECT host, 'relaxed', alerted = 1, positive = 1 FROM node_sets WHERE positive = 1 OR suspect = 0),
c AS (SELECT host, mode, {_CONF} FROM m GROUP BY host, mode) SELECT host, mode, tp, fp, fn, tn, {rates('tp', 'fp', 'fn')} FROM c""",
    "process_confusion": f"""
WITH p AS (SELECT l.host, l.actor_id, bool_or(l.label > 0) AS pos, bool_or(l.score >= a.thr) AS is_alert FROM labeled l JOIN action_thresholds a ON a.action = l.action WHERE l.split = 'test' GROUP BY l.host, l.actor_id),
c AS (SELECT host, {_CONF} FROM p GROUP BY host) SELECT host, tp, fp, fn, tn, {rates('tp', 'fp', 'fn')} FROM c""",
    "attack_window_metrics": """
SELECT w.name, count(a.event_id) AS n_alerts, count(a.event_id) > 0 AS detected, round((min(a.ts_us) - min(/*spark unix_micros(CAST(w.start_ts AS TIMESTAMP))*//*duck epoch_us(w.start_ts)*/)) / 1000000.0E0, 6) AS seconds_to_detect
FROM attack_windows w LEFT JOIN alerts a ON a.ts BETWEEN w.start_ts AND w.end_ts AND a.label > 0 GROUP BY w.name""",
    "average_precision": """
WITH c AS (SELECT host, label > 0 AS pos, rk, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY rk) AS tp, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY host) AS p FROM test_ranked)
SELECT host, CAST(max(p) AS BIGINT) AS positives, round(sum(CASE WHEN pos THEN tp / CAST(rk AS DOUBLE) ELSE 0.0 END) / max(p), 9) AS average_precision FROM c GROUP BY host""",
    "roc_auc": """
WITH r AS (SELECT host, label > 0 AS pos, n - rk + 1 AS up FROM test_ranked)
SELECT host, round((sum(CASE WHEN pos THEN up ELSE 0 END) - count_if(pos) * (count_if(pos) + 1) / 2.0) / (count_if(pos) * CAST(count_if(NOT pos) AS DOUBLE)), 9) AS auc FROM r GROUP BY host""",
    "recall_at_k": "SELECT host, k, round(count_if(rk <= k AND label > 0) / CAST(count_if(label > 0) AS DOUBLE), 9) AS recall FROM test_ranked CROSS JOIN ks GROUP BY host, k",
    "topk_precision": "SELECT host, k, count_if(is_bad = 1) AS tp, count_if(is_bad = 0) AS fp, round(avg(CAST(is_bad AS DOUBLE)), 9) AS precision FROM node_ranked JOIN ks ON rk <= k GROUP BY host, k",
    "node_topk_sweep": f"""
WITH s AS (SELECT r.host, k.k, count_if(r.rk <= k.k AND r.is_bad = 1) AS tp, count_if(r.rk <= k.k AND r.is_bad = 0) AS fp, count_if(r.rk > k.k AND r.is_bad = 1) AS fn FROM node_ranked r CROSS JOIN ks k GROUP BY r.host, k.k)
SELECT host, k, tp, fp, fn, {rates('tp', 'fp', 'fn')}, rank() OVER (PARTITION BY host ORDER BY CASE WHEN fp < 1000 THEN tp ELSE -1 END DESC, fp) AS rank_under_cap FROM s""",
    "budget_tail_metrics": """
SELECT host, budget, count(*) AS selected, count_if(label > 0) AS tp, count_if(label = 0) AS fp, round(avg(CASE WHEN label > 0 THEN 1.0E0 ELSE 0.0E0 END), 9) AS precision, min(score) AS threshold, count(DISTINCT CASE WHEN label > 0 THEN actor_id END) AS tp_actors, min(CASE WHEN label > 0 THEN rk END) AS first_tp_rank
FROM test_ranked JOIN budgets ON rk <= budget GROUP BY host, budget""",
    "categorical_lift": """
SELECT feature, value, count(*) AS n, count_if(label > 0) AS tp, count_if(label = 0) AS fp, round(count_if(label = 0) / nullif(CAST(count_if(label > 0) AS DOUBLE), 0), 9) AS fp_per_tp FROM (
  SELECT 'action' AS feature, action AS value, label FROM alerts UNION ALL SELECT 'src_kind', src_kind, label FROM alerts UNION ALL SELECT 'dst_kind', dst_kind, label FROM alerts UNION ALL SELECT 'type_pair', concat(src_kind, '->', dst_kind), label FROM alerts) x GROUP BY feature, value""",
    "numeric_fp_tp_summary": """
SELECT feature, round(avg(CASE WHEN label = 0 THEN x END), 4) AS fp_mean, round(avg(CASE WHEN label > 0 THEN x END), 4) AS tp_mean,
  round(percentile_cont(0.5) WITHIN GROUP (ORDER BY CASE WHEN label = 0 THEN x END), 4) AS fp_p50, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY CASE WHEN label = 0 THEN x END), 4) AS fp_p90,
  round(percentile_cont(0.5) WITHIN GROUP (ORDER BY CASE WHEN label > 0 THEN x END), 4) AS tp_p50, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY CASE WHEN label > 0 THEN x END), 4) AS tp_p99 FROM (
  SELECT 'score' AS feature, score AS x, label FROM alerts UNION ALL SELECT 'margin', score - thr, label FROM alerts UNION ALL SELECT 'stream_pos', CAST(stream_pos AS DOUBLE), label FROM alerts) u GROUP BY feature""",
    "component_audit": """
WITH c AS (SELECT host, 'score' AS component, score AS x, label, event_id FROM labeled WHERE split = 'test' UNION ALL SELECT host, 'margin', l.score - a.thr, label, event_id FROM labeled l JOIN action_thresholds a ON a.action = l.action WHERE split = 'test'),
r AS (SELECT *, row_number() OVER (PARTITION BY host, component ORDER BY x DESC, event_id) AS rk FROM c)
SELECT host, component, round(avg(CASE WHEN label > 0 THEN x END) - avg(CASE WHEN label = 0 THEN x END), 4) AS gap, count_if(rk <= 100 AND label > 0) AS tp_100, count_if(rk <= 1000 AND label > 0) AS tp_1000 FROM r GROUP BY host, component""",
    "robust_stats": """
WITH m AS (SELECT action, percentile_cont(0.5) WITHIN GROUP (ORDER BY score) AS med FROM labeled WHERE split = 'validation' AND label = 0 GROUP BY action)
SELECT m.action, round(max(m.med), 6) AS median, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY abs(l.score - m.med)) + 0.000001, 6) AS mad, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY l.score), 6) AS q95, round(percentile_cont(0.999) WITHIN GROUP (ORDER BY l.score), 6) AS q999
FROM labeled l JOIN m ON m.action = l.action WHERE l.split = 'validation' AND l.label = 0 GROUP BY m.action""",
    "upper_z": """
WITH m AS (SELECT action, percentile_cont(0.5) WITHIN GROUP (ORDER BY score) AS med FROM flow WHERE split = 'validation' GROUP BY action),
d AS (SELECT m.action, max(m.med) AS med, percentile_cont(0.5) WITHIN GROUP (ORDER BY abs(l.score - m.med)) + 0.000001 AS mad FROM flow l JOIN m ON m.action = l.action WHERE l.split = 'validation' GROUP BY m.action)
SELECT f.host, f.event_id, round(least(20.0, greatest((f.score - d.med) / (1.4826 * d.mad), 0.0)), 6) AS z FROM flow f JOIN d ON d.action = f.action WHERE f.split = 'test'""",
    "label_group_summary": "SELECT split, label, count(*) AS n, round(avg(score), 4) AS mean_score, min(score) AS min_score, max(score) AS max_score, round(stddev_samp(score), 4) AS std_score FROM labeled GROUP BY split, label",
    "alert_delay_metrics": """
WITH f AS (SELECT host, min(stream_pos) AS first_pos FROM labeled WHERE split = 'test' AND label = 2 GROUP BY host)
SELECT a.host, count_if(a.label = 2 AND a.stream_pos >= f.first_pos) AS tp_after, count_if(a.label = 0 AND a.stream_pos < f.first_pos) AS fp_before, round(avg(CASE WHEN a.label = 2 THEN a.stream_pos - f.first_pos END), 4) AS mean_delay,
  round(percentile_cont(0.5) WITHIN GROUP (ORDER BY CASE WHEN a.label = 2 THEN CAST(a.stream_pos - f.first_pos AS DOUBLE) END), 4) AS median_delay, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY CASE WHEN a.label = 2 THEN CAST(a.stream_pos - f.first_pos AS DOUBLE) END), 4) AS p90_delay
FROM alerts a JOIN f ON f.host = a.host GROUP BY a.host""",
    "episode_alert_metrics": """
SELECT a.host, count_if(g.node_id IS NOT NULL OR o.node_id IS NOT NULL) AS any_endpoint_tp, count_if(a.label = 0) AS strict_fp, count_if(a.label = 0 AND w.name IS NULL) AS relaxed_fp, count_if(w.name IS NOT NULL) AS in_window FROM alerts a
LEFT JOIN gt_nodes g ON g.node_id = a.info_src LEFT JOIN gt_nodes o ON o.node_id = a.info_dst LEFT JOIN attack_windows w ON a.ts BETWEEN w.start_ts AND w.end_ts GROUP BY a.host""",
    "event_alert_metrics": "SELECT host, count(*) AS n_alerts, count_if(label = 2) AS malicious, count_if(label = 1) AS suspicious, round(avg(CASE WHEN label > 0 THEN 1.0E0 ELSE 0.0E0 END), 9) AS tp_ratio FROM alerts GROUP BY host",
    "fp_per_day": """
SELECT t.host, t.days, coalesce(a.fp, 0) AS fp, round(coalesce(a.fp, 0) / CAST(t.days AS DOUBLE), 9) AS fp_per_day FROM (SELECT host, count(DISTINCT CAST(ts AS DATE)) AS days FROM flow WHERE split = 'test' GROUP BY host) t
LEFT JOIN (SELECT host, count(*) AS fp FROM alerts WHERE label = 0 GROUP BY host) a ON a.host = t.host""",
    "fbeta_threshold_search": """
WITH q AS (SELECT host, score, row_number() OVER (PARTITION BY host ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY host) AS n FROM labeled WHERE split = 'validation' AND label = 0),
qs AS (SELECT 0.9 AS q UNION ALL SELECT 0.95 UNION ALL SELECT 0.99 UNION ALL SELECT 0.995 UNION ALL SELECT 0.999),
cand AS (SELECT host, qs.q, max(CASE WHEN r = ceil(qs.q * (n - 1)) THEN score END) AS thr FROM q CROSS JOIN qs GROUP BY host, qs.q),
m AS (SELECT c.host, c.q, c.thr, count_if(l.score >= c.thr AND l.label > 0) AS tp, count_if(l.score >= c.thr AND l.label = 0) AS fp, count_if(l.score < c.thr AND l.label > 0) AS fn FROM cand c JOIN labeled l ON l.host = c.host AND l.split = 'test' GROUP BY c.host, c.q, c.thr),
f AS (SELECT *, 1.0625 * tp / nullif(1.0625 * tp + 0.0625 * fn + fp, 0) AS fbeta FROM m)
SELECT host, CAST(q AS DOUBLE) AS q, thr, tp, fp, fn, round(CAST(fbeta AS DOUBLE), 9) AS fbeta, row_number() OVER (PARTITION BY host ORDER BY fbeta DESC, fp, q) AS choice FROM f""",
    "weight_grid_search": """
WITH w AS (SELECT 0 AS weight_id, 1.0 AS a, 0.0 AS b UNION ALL SELECT 1, 0.5, 0.5 UNION ALL SELECT 2, 0.0, 1.0),
s AS (SELECT l.host, w.weight_id, l.label, l.event_id, w.a * l.score + w.b * (l.score - t.thr) AS x FROM labeled l JOIN action_thresholds t ON t.action = l.action CROSS JOIN w WHERE l.split = 'test'),
r AS (SELECT *, row_number() OVER (PARTITION BY host, weight_id ORDER BY x DESC, event_id) AS rk FROM s)
SELECT host, weight_id, count_if(rk <= 100 AND label > 0) AS tp, count_if(rk <= 100 AND label = 0) AS fp FROM r GROUP BY host, weight_id""",
    "group_threshold_sweep": """
WITH grid AS (SELECT 0.9 AS q, 0.0 AS margin UNION ALL SELECT 0.99, 0.0 UNION ALL SELECT 0.9, 500.0 UNION ALL SELECT 0.99, 500.0),
v AS (SELECT r.action, g.q, g.margin, max(CASE WHEN r.r = ceil(g.q * (r.n - 1)) THEN r.score END) + g.margin AS thr FROM action_ranked r CROSS JOIN grid g GROUP BY r.action, g.q, g.margin)
SELECT CAST(v.q AS DOUBLE) AS q, CAST(v.margin AS DOUBLE) AS margin, count_if(l.label > 0) AS tp, count_if(l.label = 0) AS fp, count(DISTINCT CASE WHEN l.label > 0 THEN l.actor_id END) AS tp_actors, count(DISTINCT CASE WHEN l.label = 0 THEN l.actor_id END) AS fp_actors
FROM labeled l JOIN v ON v.action = l.action WHERE l.split = 'test' AND l.score >= v.thr GROUP BY v.q, v.margin""",
    "ranked_node_evidence": "SELECT host, CASE WHEN rk <= 100 THEN 'top' ELSE 'rest' END AS band, kind, count_if(is_bad = 1) AS tp, count_if(is_bad = 0) AS negative, max(node_score) AS max_score FROM node_ranked GROUP BY host, CASE WHEN rk <= 100 THEN 'top' ELSE 'rest' END, kind",
    "malicious_pair_audit": "SELECT f.host, f.event_id, f.action, s.tokens AS src_tokens, d.tokens AS dst_tokens FROM flow f JOIN gt_nodes a ON a.node_id = f.info_src JOIN gt_nodes b ON b.node_id = f.info_dst JOIN node_words s ON s.node_id = f.info_src JOIN node_words d ON d.node_id = f.info_dst",
    "rank_nodes": "SELECT host, node_id, node_score, rk FROM node_ranked",
    "topm_per_node": "SELECT host, node_id, event_id, score, r FROM (SELECT t.*, row_number() OVER (PARTITION BY host, node_id ORDER BY score DESC, stream_pos) AS r FROM touch t WHERE split = 'test') x WHERE r <= 32",
    "top_events": "SELECT host, event_id, score, rk FROM test_ranked WHERE rk <= 1000",
    "balanced_sample": """
SELECT host, pair, event_id, stream_pos FROM (SELECT host, CASE WHEN object_kind = 'file' THEN 'process-file' WHEN object_kind = 'netflow' THEN 'process-netflow' ELSE 'process-process' END AS pair, event_id, stream_pos,
  row_number() OVER (PARTITION BY host, object_kind ORDER BY stream_pos) AS r FROM flow) x WHERE r <= 50""",
    "node_pool": """
WITH x AS (SELECT t.*, greatest(t.score - a.thr, 0.0) AS residual FROM touch t JOIN action_thresholds a ON a.action = t.action WHERE t.split = 'test'),
r AS (SELECT *, row_number() OVER (PARTITION BY host, node_id ORDER BY score DESC, stream_pos) AS r, row_number() OVER (PARTITION BY host, node_id ORDER BY residual DESC, stream_pos) AS q FROM x),
p AS (SELECT host, node_id, sum(CASE WHEN r <= 32 THEN score ELSE 0.0 END) AS mass, sum(CASE WHEN q <= 32 THEN residual ELSE 0.0 END) AS residual_mass, count(*) AS n, count(DISTINCT concat_ws('|', CAST(as_src AS STRING), CAST(peer AS STRING))) AS chains,
  count(DISTINCT concat_ws('|', action, CAST(peer AS STRING))) AS action_peers FROM r GROUP BY host, node_id),
l AS (SELECT *, ln(1 + residual_mass) AS lr, ln(1 + n / CAST(chains AS DOUBLE)) AS lp, ln(1 + chains) AS lc, ln(1 + action_peers) AS la FROM p)
SELECT host, node_id, n, chains, action_peers, round(mass, 4) AS mass, round(residual_mass, 4) AS residual_mass, round(mass, 4) AS base, round(mass, 4) AS base_conf, round(mass + lp, 4) AS base_conf_repeat, round(mass + lc, 4) AS base_conf_chain,
  round(mass + lr, 4) AS base_conf_residual, round(mass + lp + lc, 4) AS base_conf_repeat_chain, round(mass + lr + lp + lc, 4) AS base_conf_residual_repeat_chain, round(mass, 4) AS pool_base, round(mass + lr, 4) AS pool_base_adaptive,
  round(mass + la, 4) AS pool_base_assoc, round(mass + lc, 4) AS pool_base_chain, round(mass + lr + la + lc, 4) AS pool_base_adaptive_assoc_chain FROM l""",
    "prefix_alert_sweep": """
WITH a AS (SELECT host, label, info_src, row_number() OVER (PARTITION BY host ORDER BY stream_pos) AS r FROM alerts)
SELECT host, k, count(*) AS n, count_if(label > 0) AS tp, count_if(label = 0) AS fp, count(DISTINCT info_src) AS sources FROM a JOIN ks ON r <= k GROUP BY host, k""",
}
