"""Scans, projections, joins and set operations over events and nodes."""

from __future__ import annotations

from tracewell.sources.mapping import _ACTIONS

_SECRET_ORDER = "md5(concat(CAST(actor_id AS STRING), 's'))"

TEXTS: dict[str, str] = {
    # scans
    "node_lookup": """
SELECT node_id, max(uuid) AS uuid, max_by(kind, pri) AS kind, max_by(summary, pri) AS summary FROM (
  SELECT node_id, uuid, kind, CASE kind WHEN 'netflow' THEN 0 WHEN 'process' THEN 1 ELSE 2 END AS pri,
    CASE kind WHEN 'netflow' THEN concat_ws(':', dst_addr, dst_port) WHEN 'process' THEN concat_ws(' ', path, cmd) ELSE path END AS summary FROM prov_nodes) x GROUP BY node_id""",
    "scan_events_by_days": "SELECT host, event_id, ts_us, src_id, dst_id, action FROM prov_events WHERE ts >= TIMESTAMP '1999-03-01 05:00:00' AND ts < TIMESTAMP '1999-03-11 05:00:00'",
    "scan_events_multi_day": """
SELECT host, event_id, ts_us, action FROM prov_events WHERE (ts >= TIMESTAMP '1998-02-01 05:00:00' AND ts < TIMESTAMP '1998-02-03 05:00:00')
  OR (ts >= TIMESTAMP '1999-07-04 04:00:00' AND ts < TIMESTAMP '1999-07-06 04:00:00') OR (ts >= TIMESTAMP '2001-01-02 05:00:00' AND ts < TIMESTAMP '2001-01-05 05:00:00')""",
    "bounded_scan": "SELECT host, event_id, ts_us, action FROM prov_events ORDER BY ts_us, event_id LIMIT 1000",
    "split_event_counts": f"""
SELECT split, count(*) AS n_events, count_if(action IN ({_ACTIONS})) AS n_scored, min(ts_us) AS first_us, max(ts_us) AS last_us FROM prov_events GROUP BY split""",
    "ground_truth_nodes": "SELECT DISTINCT uuid, node_id FROM gt_nodes WHERE uuid IS NOT NULL AND uuid <> ''",
    "structured_event_export": """
SELECT f.split, f.event_id, f.ts_us * 1000 AS timestamp_ns, f.actor_id AS process_idx, f.action, f.object_kind AS object_type, f.info_src AS src_idx, f.info_dst AS dst_idx, f.label,
  concat_ws(' ', 'A_PROCESS', a.path, f.action, concat('O_', upper(f.object_kind)), CASE WHEN f.object_kind = 'netflow' THEN concat_ws(':', o.dst_addr, o.dst_port) ELSE regexp_replace(o.path, '/+', '/'/*duck , 'g'*/) END) AS text
FROM labeled f JOIN prov_nodes a ON a.node_id = f.actor_id JOIN prov_nodes o ON o.node_id = f.object_id""",
    "compact_event_index": """
SELECT host, split, stream_pos, event_id, info_src, info_dst,
  CASE action WHEN 'EVENT_CLONE' THEN 0 WHEN 'EVENT_CONNECT' THEN 1 WHEN 'EVENT_EXECUTE' THEN 2 WHEN 'EVENT_OPEN' THEN 3 WHEN 'EVENT_READ' THEN 4 WHEN 'EVENT_RECVFROM' THEN 5
    WHEN 'EVENT_RECVMSG' THEN 6 WHEN 'EVENT_SENDMSG' THEN 7 WHEN 'EVENT_SENDTO' THEN 8 ELSE 9 END AS action_id,
  CASE src_kind WHEN 'process' THEN 0 WHEN 'file' THEN 1 WHEN 'netflow' THEN 2 ELSE 3 END AS src_type,
  CASE dst_kind WHEN 'process' THEN 0 WHEN 'file' THEN 1 WHEN 'netflow' THEN 2 ELSE 3 END AS dst_type FROM flow""",
    # projections and predicates
    "ten_action_filter": f"""
SELECT host, count(*) AS n_before, count_if(action IN ({_ACTIONS})) AS n_after, count(DISTINCT action) AS actions_before, count(DISTINCT CASE WHEN action IN ({_ACTIONS}) THEN action END) AS actions_after
FROM prov_events GROUP BY host""",
    "actor_normalize": """
SELECT e.host, e.event_id, CASE WHEN s.kind = 'process' THEN e.src_id ELSE e.dst_id END AS actor_id, CASE WHEN s.kind = 'process' THEN e.dst_id ELSE e.src_id END AS object_id,
  CASE WHEN s.kind = 'process' THEN d.kind ELSE s.kind END AS object_kind, CASE WHEN s.kind = 'process' THEN d.dst_addr ELSE s.dst_addr END AS object_addr, s.kind <> 'process' AS swapped
FROM prov_events e JOIN prov_nodes s ON s.node_id = e.src_id JOIN prov_nodes d ON d.node_id = e.dst_id WHERE s.kind = 'process' OR d.kind = 'process'""",
    "information_flow": """
SELECT host, event_id, info_src, info_dst, src_kind, dst_kind, CASE action WHEN 'EVENT_READ' THEN 'read' WHEN 'EVENT_RECVFROM' THEN 'recv' WHEN 'EVENT_RECVMSG' THEN 'recv' WHEN 'EVENT_WRITE' THEN 'write'
  WHEN 'EVENT_SENDTO' THEN 'send' WHEN 'EVENT_SENDMSG' THEN 'send' WHEN 'EVENT_CONNECT' THEN 'send' WHEN 'EVENT_EXECUTE' THEN 'spawn' WHEN 'EVENT_CLONE' THEN 'spawn' WHEN 'EVENT_OPEN' THEN 'open' ELSE 'other' END AS relation
FROM prov_flow""",
    "action_family": """
SELECT action, CASE WHEN action IN ('EVENT_READ', 'EVENT_OPEN') THEN 'read' WHEN action IN ('EVENT_RECVFROM', 'EVENT_RECVMSG') THEN 'recv' WHEN action = 'EVENT_WRITE' THEN 'write'
  WHEN action IN ('EVENT_SENDTO', 'EVENT_SENDMSG', 'EVENT_CONNECT') THEN 'send' WHEN action IN ('EVENT_EXECUTE', 'EVENT_CLONE', 'EVENT_FORK') THEN 'spawn' ELSE 'other' END AS family, count(*) AS n FROM prov_events GROUP BY action""",
    "event_label": "SELECT host, event_id, label FROM labeled",
    "label_free_projection": "SELECT host, stream_pos, event_id, ts_us, action, info_src, info_dst, src_kind, dst_kind FROM flow",
    "resolved_events_only": """
SELECT e.host, count(*) AS n_events, count_if(s.node_id IS NOT NULL AND d.node_id IS NOT NULL) AS n_resolved, count_if(s.node_id IS NULL OR d.node_id IS NULL) AS n_skipped
FROM prov_events e LEFT JOIN prov_nodes s ON s.node_id = e.src_id LEFT JOIN prov_nodes d ON d.node_id = e.dst_id GROUP BY e.host""",
    "netflow_message": """
SELECT node_id, kind, CASE kind WHEN 'netflow' THEN dst_addr WHEN 'process' THEN nullif(concat_ws(' ', path, cmd), '') ELSE regexp_replace(path, '/+', '/'/*duck , 'g'*/) END AS message,
  CASE WHEN kind = 'netflow' THEN concat_ws(':', dst_addr, dst_port) END AS message_with_port FROM prov_nodes""",
    "event_text": """
SELECT f.host, f.event_id, concat_ws(' ', 'A_PROCESS', a.path, f.action, concat('O_', upper(f.object_kind)), CASE WHEN f.object_kind = 'netflow' THEN concat_ws(':', o.dst_addr, o.dst_port) ELSE regexp_replace(o.path, '/+', '/'/*duck , 'g'*/) END) AS text
FROM flow f JOIN prov_nodes a ON a.node_id = f.actor_id JOIN prov_nodes o ON o.node_id = f.object_id""",
    "residual_sentence": """
SELECT f.host, f.event_id, concat_ws(' ', s.tokens, lower(f.action), d.tokens) AS sentence FROM flow f JOIN node_words s ON s.node_id = f.info_src JOIN node_words d ON d.node_id = f.info_dst""",
    "alert_predicate": "SELECT f.host, f.event_id, f.score, t.thr AS threshold FROM flow f JOIN action_thresholds t ON t.action = f.action WHERE f.split = 'test' AND f.score >= t.thr",
    "suppression_candidate": """
SELECT host, event_id, action = 'EVENT_WRITE' AND src_kind = 'process' AND dst_kind = 'netflow' AS write_out, action = 'EVENT_READ' AND src_kind = 'netflow' AND dst_kind = 'process' AS read_in FROM flow""",
    "alert_policy": """
WITH x AS (SELECT f.host, f.event_id, p.policy, f.score >= t.thr AS over, coalesce(r.decision, d.decision) AS decided FROM flow f JOIN action_thresholds t ON t.action = f.action
CROSS JOIN (SELECT DISTINCT policy FROM policy_default) p JOIN policy_default d ON d.policy = p.policy
LEFT JOIN policy_rules r ON r.policy = p.policy AND r.action = f.action AND r.src_kind = f.src_kind AND r.dst_kind = f.dst_kind WHERE f.split = 'test')
SELECT host, event_id, policy, CASE WHEN over THEN decided ELSE 'not_alert' END AS decision, CASE WHEN NOT over THEN '' WHEN decided = 'high' THEN 'high' WHEN decided = 'alert' THEN 'default' ELSE 'low' END AS priority, over AND decided <> 'evidence' AS is_final FROM x""",
    "label_normalize": """
SELECT event_id, raw, CASE WHEN lower(trim(raw)) IN ('1', '2', 'true', 'malicious', 'attack', 'suspicious') THEN 1 ELSE 0 END AS is_attack,
  CASE WHEN lower(trim(raw)) IN ('2', 'malicious', 'attack') THEN 'malicious' WHEN lower(trim(raw)) IN ('1', 'suspicious', 'true') THEN 'suspicious' ELSE 'benign' END AS name
FROM (SELECT event_id, CASE label WHEN 2 THEN ' Malicious' WHEN 1 THEN 'SUSPICIOUS ' ELSE 'benign' END AS raw FROM labeled) x""",
    "target_case": "SELECT host, event_id, target_case, src_active, dst_active FROM cased",
    "alert_features": """
SELECT a.host, a.event_id, concat(a.src_kind, '->', a.dst_kind) AS type_pair, round(a.score - a.thr, 6) AS margin, coalesce(s.path LIKE '%/tmp%' OR d.path LIKE '%/tmp%', FALSE) AS has_tmp,
  coalesce(s.path LIKE '%.so%' OR d.path LIKE '%.so%', FALSE) AS has_so, concat_ws('|', a.action, a.src_kind, a.dst_kind) AS alert_group
FROM alerts a JOIN prov_nodes s ON s.node_id = a.info_src JOIN prov_nodes d ON d.node_id = a.info_dst""",
    # joins
    "enrich_events": """
SELECT e.host, e.event_id, e.action, s.kind AS src_kind, s.path AS src_path, s.cmd AS src_cmd, d.kind AS dst_kind, d.path AS dst_path, d.dst_addr, d.dst_port
FROM prov_events e JOIN prov_nodes s ON s.node_id = e.src_id JOIN prov_nodes d ON d.node_id = e.dst_id WHERE s.kind = 'process' OR d.kind = 'process'""",
    "used_nodes": "SELECT n.* FROM prov_nodes n WHERE n.node_id IN (SELECT info_src FROM flow UNION SELECT info_dst FROM flow)",
    "gt_resolve": """
SELECT g.uuid, coalesce(n.node_id, try_cast(g.old_index AS BIGINT)) AS node_id FROM (
  SELECT uuid, CAST(node_id + 7 AS STRING) AS old_index FROM gt_nodes UNION ALL SELECT 'missing', '42' UNION ALL SELECT 'bad', 'x1') g LEFT JOIN prov_nodes n ON n.uuid = g.uuid""",
    "missing_node_check": """
SELECT DISTINCT x.node_id FROM (SELECT src_id AS node_id FROM prov_events UNION SELECT dst_id FROM prov_events) x LEFT JOIN prov_nodes n ON n.node_id = x.node_id WHERE n.node_id IS NULL""",
    "alert_event_labels": "SELECT a.host, a.event_id, coalesce(l.label, 0) AS label FROM (SELECT host, event_id FROM alerts) a LEFT JOIN (SELECT host, event_id, label FROM labeled) l ON l.host = a.host AND l.event_id = a.event_id",
    "alert_node_labels": "SELECT t.node_id, max(CASE WHEN g.node_id IS NULL THEN 0 ELSE 1 END) AS malicious FROM alert_touch t LEFT JOIN gt_nodes g ON g.node_id = t.node_id GROUP BY t.node_id",
    "endpoint_history": """
WITH known AS (SELECT src, endpoint, action FROM history WHERE split <> 'test')
SELECT h.host, h.event_id, coalesce(a.n, 0) AS n_src_endpoint_action, coalesce(b.n, 0) AS n_src_endpoint, coalesce(c.n, 0) AS n_endpoint_action FROM (SELECT * FROM history WHERE split = 'test') h
LEFT JOIN (SELECT src, endpoint, action, count(*) AS n FROM known GROUP BY src, endpoint, action) a ON a.src = h.src AND a.endpoint = h.endpoint AND a.action = h.action
LEFT JOIN (SELECT src, endpoint, count(*) AS n FROM known GROUP BY src, endpoint) b ON b.src = h.src AND b.endpoint = h.endpoint
LEFT JOIN (SELECT endpoint, action, count(*) AS n FROM known GROUP BY endpoint, action) c ON c.endpoint = h.endpoint AND c.action = h.action""",
    "attack_window_join": "SELECT w.name, f.host, f.event_id, f.ts_us FROM flow f JOIN attack_windows w ON f.ts BETWEEN w.start_ts AND w.end_ts",
    "align_structured": """
SELECT p.host, count(*) AS n_predictions, count(l.event_id) AS n_aligned, count(*) = count(l.event_id) AS aligned FROM (SELECT host, event_id, score FROM flow WHERE split = 'test') p
LEFT JOIN labeled l ON l.host = p.host AND l.event_id = p.event_id GROUP BY p.host""",
    "remap_node_ids": """
WITH ids AS (SELECT host, node_id, row_number() OVER (PARTITION BY host ORDER BY node_id) - 1 AS compact_id FROM (SELECT DISTINCT host, node_id FROM touch) x)
SELECT f.host, f.event_id, s.compact_id AS src_compact, d.compact_id AS dst_compact FROM flow f JOIN ids s ON s.host = f.host AND s.node_id = f.info_src JOIN ids d ON d.host = f.host AND d.node_id = f.info_dst""",
    "tail_surprisal": """
WITH x AS (SELECT action, score, CASE WHEN split = 'validation' THEN 1 ELSE 0 END AS ref, host, event_id, split FROM flow WHERE split <> 'train'),
c AS (SELECT *, sum(ref) OVER (PARTITION BY action ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above, sum(ref) OVER (PARTITION BY action) AS n FROM x)
SELECT host, event_id, round(-ln((above + 1.0) / (n + 1.0)), 9) AS surprisal FROM c WHERE split = 'test'""",
    "conformal_pvalue": """
WITH x AS (SELECT action, score, CASE WHEN split = 'validation' THEN 1 ELSE 0 END AS ref, host, event_id, split FROM flow WHERE split <> 'train'),
c AS (SELECT *, sum(ref) OVER (PARTITION BY action ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above, sum(ref) OVER (PARTITION BY action) AS n FROM x)
SELECT host, event_id, round((above + 1.0E0) / (n + 1.0E0), 9) AS p_value FROM c WHERE split = 'test'""",
    # set operations
    "endpoint_union": "SELECT info_src AS node_id FROM flow UNION SELECT info_dst FROM flow",
    "split_set_algebra": """
SELECT 'train_and_test' AS part, node_id FROM (SELECT node_id FROM touch WHERE split = 'train' INTERSECT SELECT node_id FROM touch WHERE split = 'test') a
UNION ALL SELECT 'test_only', node_id FROM (SELECT node_id FROM touch WHERE split = 'test' EXCEPT SELECT node_id FROM touch WHERE split <> 'test') b""",
    "gt_union": "SELECT uuid FROM gt_nodes WHERE node_id < 1000000 UNION SELECT uuid FROM gt_nodes WHERE node_id % 2 = 0",
    "process_disjoint_split": f"""
WITH owners AS (SELECT host, actor_id, {_SECRET_ORDER} AS h FROM (SELECT DISTINCT host, actor_id FROM flow WHERE split = 'train') x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY h, actor_id) AS r, count(*) OVER (PARTITION BY host) AS n FROM owners)
SELECT f.host, CASE WHEN r.n >= 2 AND r.r <= greatest(1, least(n - 1, ceil(0.1 * n))) THEN 'val' ELSE 'train' END AS part, count(*) AS n_events, count(DISTINCT f.actor_id) AS n_owners
FROM flow f JOIN ranked r ON r.host = f.host AND r.actor_id = f.actor_id WHERE f.split = 'train' GROUP BY 1, 2""",
    "day_splits": """
SELECT split, CAST(ts AS DATE) AS day, count(*) AS n, min(ts_us) AS first_us FROM prov_events GROUP BY split, CAST(ts AS DATE)""",
}

#: rules as rows: users add their own
COMMON: dict[str, str] = {
    "node_words": """
SELECT node_id, kind, CASE kind WHEN 'netflow' THEN concat('ip_', replace(dst_addr, '.', '_')) WHEN 'process' THEN coalesce(replace(path, '/', ' '), 'unknown') ELSE replace(path, '/', ' ') END AS tokens FROM prov_nodes""",
    # Alert policy rows (action, source, destination) -> decision, and each policy's default.
    "policy_rules": """
SELECT policy, action, src_kind, dst_kind, decision FROM (VALUES
  ('cadets_e4_v2_group_v1', 'EVENT_RECVFROM', 'netflow', 'process', 'high'), ('cadets_e4_v2_group_v1', 'EVENT_CONNECT', 'process', 'netflow', 'evidence'), ('cadets_e4_v2_group_v1', 'EVENT_WRITE', 'process', 'netflow', 'evidence'),
  ('theia_v1', 'EVENT_RECVFROM', 'netflow', 'process', 'high'), ('theia_v1', 'EVENT_CONNECT', 'process', 'netflow', 'high'), ('theia_v1', 'EVENT_OPEN', 'process', 'process', 'evidence'),
  ('theia_v1', 'EVENT_WRITE', 'process', 'file', 'evidence'), ('theia_v1', 'EVENT_READ', 'file', 'process', 'evidence'),
  ('clearscope_node_pair_v1', 'EVENT_READ', 'file', 'process', 'high'), ('clearscope_node_pair_v1', 'EVENT_RECVFROM', 'netflow', 'process', 'high'), ('clearscope_node_pair_v1', 'EVENT_CONNECT', 'process', 'netflow', 'high'),
  ('clearscope_android_v2', 'EVENT_RECVFROM', 'netflow', 'process', 'high'), ('clearscope_android_v2', 'EVENT_CONNECT', 'process', 'netflow', 'high')) v(policy, action, src_kind, dst_kind, decision)""",
    "policy_default": """
SELECT policy, decision FROM (VALUES ('default', 'alert'), ('cadets_e4_v2_group_v1', 'alert'), ('theia_v1', 'alert'), ('clearscope_node_pair_v1', 'evidence'), ('clearscope_android_v2', 'evidence')) d(policy, decision)""",
}
