"""The audit model over the given tables: nodes, events, information flow, ground truth, attack windows.

Order within a host is always (ts, event_id). ``flow`` holds the scored events between resolved endpoints, each with its
place in its host's stream; ``labeled`` adds labels and must only be read after scoring.
"""

from __future__ import annotations

# The ten scored actions, in the order of their ids.
ACTIONS = ("EVENT_CLONE", "EVENT_CONNECT", "EVENT_EXECUTE", "EVENT_OPEN", "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG", "EVENT_SENDMSG", "EVENT_SENDTO", "EVENT_WRITE")
_ACTIONS = ",".join(f"'{a}'" for a in ACTIONS)

BASE: dict[str, str] = {
    "prov_nodes": """
SELECT CAST(s_suppkey AS BIGINT) AS node_id, concat('U', CAST(s_suppkey AS STRING)) AS uuid, 'process' AS kind,
  CASE s_suppkey % 6 WHEN 0 THEN '/usr/sbin/nginx' WHEN 1 THEN '/bin/bash' WHEN 2 THEN '/usr/bin/python3' WHEN 3 THEN '/usr/sbin/sshd' WHEN 4 THEN '/usr/bin/wget' ELSE NULL END AS path,
  CASE s_suppkey % 6 WHEN 0 THEN 'nginx -g daemon' WHEN 1 THEN 'bash -c /tmp/run.sh' WHEN 2 THEN 'python3 /opt/app/main.py' WHEN 3 THEN 'sshd' WHEN 4 THEN 'wget http://example.org/a' ELSE NULL END AS cmd,
  CAST(NULL AS STRING) AS dst_addr, CAST(NULL AS STRING) AS dst_port
FROM supplier
UNION ALL
SELECT 1000000 + CAST(p_partkey AS BIGINT) AS node_id, concat('U', CAST(1000000 + p_partkey AS STRING)) AS uuid,
  CASE p_partkey % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'netflow' ELSE 'process' END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN concat(CASE p_partkey % 5 WHEN 0 THEN '/tmp/' WHEN 1 THEN '/etc/' WHEN 2 THEN '/var/log/' WHEN 3 THEN '/usr/lib//' ELSE '/home/u/' END, replace(p_name, ' ', '_'), '.', lower(p_type))
       WHEN p_partkey % 3 = 2 THEN concat('/usr/bin/', replace(p_name, ' ', '_')) END AS path,
  CASE WHEN p_partkey % 3 = 2 THEN replace(p_name, ' ', '_') END AS cmd,
  CASE WHEN p_partkey % 3 = 1 THEN concat(CASE p_partkey % 4 WHEN 0 THEN '10.0.' WHEN 1 THEN '128.55.' WHEN 2 THEN '127.0.' ELSE '203.0.' END, CAST(p_partkey % 17 AS STRING), '.', CAST(p_partkey % 251 AS STRING)) END AS dst_addr,
  CASE WHEN p_partkey % 3 = 1 THEN CAST(p_partkey * 37 % 65536 AS STRING) END AS dst_port
FROM part""",
    "prov_events": """
SELECT concat('h', CAST(l_suppkey % 4 AS STRING)) AS host,
  (CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 100000000000 + CAST(l_partkey AS BIGINT) * 1000000 + CAST(l_suppkey AS BIGINT) * 100 + CAST(l_quantity AS BIGINT) AS event_id,
  l_shipdate AS ts, /*spark unix_micros(CAST(l_shipdate AS TIMESTAMP))*//*duck epoch_us(l_shipdate)*/ AS ts_us,
  CASE WHEN l_linenumber = 7 THEN 1000000 + CAST(l_partkey - l_partkey % 3 AS BIGINT)
       WHEN l_linenumber % 2 = 0 THEN 1000000 + CAST(l_partkey AS BIGINT) ELSE CAST(l_suppkey AS BIGINT) END AS src_id,
  CASE WHEN l_linenumber = 6 AND l_quantity = 50 THEN -1
       WHEN l_linenumber <> 7 AND l_linenumber % 2 = 0 THEN CAST(l_suppkey AS BIGINT) ELSE 1000000 + CAST(l_partkey AS BIGINT) END AS dst_id,
  CASE (l_linenumber * 5 + l_partkey) % 12 WHEN 0 THEN 'EVENT_CLONE' WHEN 1 THEN 'EVENT_CONNECT' WHEN 2 THEN 'EVENT_EXECUTE' WHEN 3 THEN 'EVENT_OPEN'
    WHEN 4 THEN 'EVENT_READ' WHEN 5 THEN 'EVENT_RECVFROM' WHEN 6 THEN 'EVENT_RECVMSG' WHEN 7 THEN 'EVENT_SENDMSG' WHEN 8 THEN 'EVENT_SENDTO'
    WHEN 9 THEN 'EVENT_WRITE' WHEN 10 THEN 'EVENT_CLOSE' ELSE 'EVENT_FORK' END AS action,
  CASE WHEN l_shipdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'train' WHEN l_shipdate < TIMESTAMP '2000-01-01 00:00:00' THEN 'validation' ELSE 'test' END AS split,
  l_extendedprice AS score
FROM lineitem""",
    "prov_flow": f"""
SELECT host, event_id, ts, ts_us, split, action, score, actor_id, object_id, object_kind,
  CASE WHEN action IN ('EVENT_READ','EVENT_RECVFROM','EVENT_RECVMSG') THEN object_id ELSE actor_id END AS info_src,
  CASE WHEN action IN ('EVENT_READ','EVENT_RECVFROM','EVENT_RECVMSG','EVENT_OPEN') THEN actor_id ELSE object_id END AS info_dst,
  CASE WHEN action IN ('EVENT_READ','EVENT_RECVFROM','EVENT_RECVMSG') THEN object_kind ELSE 'process' END AS src_kind,
  CASE WHEN action IN ('EVENT_READ','EVENT_RECVFROM','EVENT_RECVMSG','EVENT_OPEN') THEN 'process' ELSE object_kind END AS dst_kind
FROM (
  SELECT e.host, e.event_id, e.ts, e.ts_us, e.split, e.action, e.score,
    CASE WHEN s.kind = 'process' THEN e.src_id ELSE e.dst_id END AS actor_id,
    CASE WHEN s.kind = 'process' THEN e.dst_id ELSE e.src_id END AS object_id,
    CASE WHEN s.kind = 'process' THEN d.kind ELSE s.kind END AS object_kind
  FROM prov_events e JOIN prov_nodes s ON s.node_id = e.src_id JOIN prov_nodes d ON d.node_id = e.dst_id
  WHERE (s.kind = 'process' OR d.kind = 'process') AND e.action IN ({_ACTIONS})
) x""",
    "gt_nodes": "SELECT node_id, uuid FROM prov_nodes WHERE (node_id < 1000000 AND node_id % 7 = 3) OR (node_id >= 1000000 AND (node_id - 1000000) % 31 = 5)",
    "attack_windows": """
SELECT 'w1' AS name, TIMESTAMP '2000-03-01 00:00:00' AS start_ts, TIMESTAMP '2000-06-30 00:00:00' AS end_ts
UNION ALL SELECT 'w2', TIMESTAMP '2030-01-01 00:00:00', TIMESTAMP '2030-02-01 00:00:00'""",
    "flow": "SELECT f.*, row_number() OVER (PARTITION BY host ORDER BY ts_us, event_id) - 1 AS stream_pos FROM prov_flow f",
    "labeled": """
SELECT f.*, CASE WHEN a.node_id IS NOT NULL AND o.node_id IS NOT NULL THEN 2 WHEN a.node_id IS NOT NULL OR o.node_id IS NOT NULL THEN 1 ELSE 0 END AS label
FROM flow f LEFT JOIN gt_nodes a ON a.node_id = f.actor_id LEFT JOIN gt_nodes o ON o.node_id = f.object_id""",
    # one row for each event and node it touches; a self-loop is one touch in both roles
    "touch": """
SELECT host, split, stream_pos, event_id, ts_us, action, score, info_src AS node_id, src_kind AS kind, info_dst AS peer, dst_kind AS peer_kind, 1 AS as_src, CASE WHEN info_src = info_dst THEN 1 ELSE 0 END AS as_dst FROM flow
UNION ALL
SELECT host, split, stream_pos, event_id, ts_us, action, score, info_dst, dst_kind, info_src, src_kind, 0, 1 FROM flow WHERE info_src <> info_dst""",
    "touch_before": """
SELECT t.*, count(*) OVER w AS n_before, coalesce(sum(as_src) OVER w, 0) AS src_before, coalesce(sum(as_dst) OVER w, 0) AS dst_before FROM touch t
WINDOW w AS (PARTITION BY host, node_id ORDER BY stream_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "active": "SELECT host, stream_pos, node_id, CASE WHEN kind = 'process' THEN n_before >= 1 ELSE n_before >= 2 OR src_before >= 1 END AS is_active FROM touch_before",
    "cased": """
SELECT f.*, CASE WHEN s.is_active OR d.is_active THEN 'event_semantic' ELSE 'both_cold_action' END AS target_case, s.is_active AS src_active, d.is_active AS dst_active
FROM flow f JOIN active s ON s.host = f.host AND s.stream_pos = f.stream_pos AND s.node_id = f.info_src
JOIN active d ON d.host = f.host AND d.stream_pos = f.stream_pos AND d.node_id = f.info_dst""",
    # an alert is a test event at or above the 0.99 quantile (higher) of its action's validation scores
    "action_ranked": "SELECT action, score, row_number() OVER (PARTITION BY action ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY action) AS n FROM flow WHERE split = 'validation'",
    "action_thresholds": "SELECT action, max(n) AS n, max(CASE WHEN r = ceil(0.99 * (n - 1)) THEN score END) AS thr, max(score) AS vmax FROM action_ranked GROUP BY action",
    "alerts": "SELECT l.*, t.thr FROM labeled l JOIN action_thresholds t ON t.action = l.action WHERE l.split = 'test' AND l.score >= t.thr",
    "alert_touch": """
SELECT host, stream_pos, event_id, ts_us, score, label, thr, info_src AS node_id, src_kind AS kind, 1 AS as_src, CASE WHEN info_src = info_dst THEN 1 ELSE 0 END AS as_dst FROM alerts
UNION ALL SELECT host, stream_pos, event_id, ts_us, score, label, thr, info_dst, dst_kind, 0, 1 FROM alerts WHERE info_src <> info_dst""",
    "node_scores": "SELECT host, node_id, max(kind) AS kind, max(score) AS node_score, count(*) AS support FROM touch WHERE split = 'test' GROUP BY host, node_id",
    "node_ranked": """
SELECT s.*, CASE WHEN g.node_id IS NULL THEN 0 ELSE 1 END AS is_bad, row_number() OVER (PARTITION BY s.host ORDER BY node_score DESC, s.node_id) AS rk
FROM node_scores s LEFT JOIN gt_nodes g ON g.node_id = s.node_id WHERE node_score > 0""",
    "ks": "SELECT 100 AS k UNION ALL SELECT 200 UNION ALL SELECT 500 UNION ALL SELECT 1000 UNION ALL SELECT 1500 UNION ALL SELECT 3000",
    "test_ranked": "SELECT host, event_id, stream_pos, score, label, actor_id, object_id, info_src, info_dst, row_number() OVER (PARTITION BY host ORDER BY score DESC, event_id) AS rk, count(*) OVER (PARTITION BY host) AS n FROM labeled WHERE split = 'test'",
    "history": """
SELECT info_src AS src, CASE WHEN n.dst_addr IS NOT NULL THEN concat(n.dst_addr, ':', coalesce(n.dst_port, '')) ELSE concat('node:', CAST(f.info_dst AS STRING)) END AS endpoint, f.action, f.split, f.host, f.event_id, f.score, f.stream_pos, f.label, f.info_dst
FROM labeled f JOIN prov_nodes n ON n.node_id = f.info_dst WHERE f.action IN ('EVENT_WRITE', 'EVENT_SENDTO') AND f.src_kind = 'process' AND f.dst_kind = 'netflow'""",
}
