"""Counts, rarity, ordered windows, token jobs and node ranking."""

from __future__ import annotations



def piece(x: str, fallback: str, most: int = 32) -> str:
    """A value as a short token, in the check's SQL."""
    low = f"lower(trim({x}))"
    plain = f"trim(regexp_replace({low}, '[^a-z0-9]+', '_', 'g'), '_')"
    return f"CASE WHEN regexp_matches({low}, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN 'uuid' WHEN regexp_matches({low}, '^[0-9a-f]{{12,}}$') THEN 'hex' WHEN regexp_matches({low}, '^[0-9]+$') THEN 'num' WHEN {plain} = '' THEN '{fallback}' ELSE rtrim(substr({plain}, 1, {most}), '_') END"


def base_signature(x: str) -> str:
    parts = f"list_filter(string_split(lower({x}), '.'), lambda p: p <> '')"
    base = f"CASE WHEN contains({x}, '.') AND len({parts}) > 0 THEN {parts}[1] ELSE lower({x}) END"
    ending = f"list_filter({parts}[2:], lambda p: regexp_matches(p, '[a-z]'))[1]"
    return f"concat_ws('_', {piece(base, 'path', 24)}, CASE WHEN {ending} IS NOT NULL THEN {piece(ending, 'x', 12)} END)"


def bucket(prefix: str, n: str) -> str:
    steps = " ".join(f"WHEN {n} <= {most} THEN '{prefix}_{name}'" for most, name in ((1, "1"), (2, "2"), (4, "3_4"), (8, "5_8"), (16, "9_16"), (32, "17_32"), (64, "33_64"), (128, "65_128")))
    return f"CASE {steps} ELSE '{prefix}_129p' END"


COMMON: dict[str, str] = {
    "train_flow": "SELECT * FROM flow WHERE split = 'train'",
    "node_tokens": """
SELECT node_id, kind, /*spark token*//*duck token*/ FROM (SELECT node_id, kind, coalesce(nullif(tokens, ''), 'unknown') AS words FROM node_words) w
/*spark LATERAL VIEW explode(split(words, ' ')) t AS token*//*duck , unnest(string_split(words, ' ')) t(token)*/ WHERE token <> ''""",
    "event_tokens": "SELECT f.host, f.split, f.event_id, t.token FROM flow f JOIN node_tokens t ON t.node_id = f.info_src UNION ALL SELECT f.host, f.split, f.event_id, t.token FROM flow f JOIN node_tokens t ON t.node_id = f.info_dst",
    "train_vocab": "SELECT token, count(*) AS n FROM event_tokens WHERE split = 'train' GROUP BY token",
    "frozen": "SELECT token, n, rid FROM (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rid FROM train_vocab WHERE n >= 5) v WHERE rid < 8192",
    # program and folder of processes, paths of files, scope and port of addresses
    "node_summaries": f"""
SELECT node_id, kind, list_transform(CASE WHEN kind = 'netflow' THEN [CASE WHEN dst_addr = '0.0.0.0' THEN 'zero' WHEN o[1] = '127' THEN 'loopback' WHEN o[1] = '128' AND o[2] = '55' THEN concat('internal_', o[3]) WHEN o[1] = '10' THEN 'private' ELSE 'public' END,
    CASE WHEN CAST(dst_port AS INT) < 1024 THEN 'system' WHEN CAST(dst_port AS INT) < 49152 THEN 'registered' ELSE 'ephemeral' END]
  WHEN kind = 'process' THEN CASE WHEN path IS NULL AND cmd IS NULL THEN ['PROC_na'] ELSE list_filter([concat('EXE_', {base_signature('s[len(s)]')}), CASE WHEN len(s) >= 2 THEN concat('DIR_', {piece('s[len(s) - 1]', 'dir', 20)}) END], lambda x: x IS NOT NULL) END
  WHEN path IS NULL OR len(s) = 0 THEN ['PATH_na'] ELSE list_filter([concat('ROOT_', CASE WHEN starts_with(path, '/') THEN {piece('s[1]', 'root')} ELSE 'rel' END), CASE WHEN len(s) >= 2 THEN concat('DIR_', {piece('s[len(s) - 1]', 'dir', 20)}) END, concat('PATH_', {base_signature('s[len(s)]')})], lambda x: x IS NOT NULL) END, lambda x: lower(x)) AS tokens
FROM (SELECT *, string_split(dst_addr, '.') AS o, list_filter(string_split(coalesce(path, ''), '/'), lambda x: x <> '') AS s FROM prov_nodes) n""",
    "families": """
SELECT f.*, CASE WHEN action IN ('EVENT_READ', 'EVENT_OPEN') THEN 'read' WHEN action IN ('EVENT_RECVFROM', 'EVENT_RECVMSG') THEN 'recv' WHEN action = 'EVENT_WRITE' THEN 'write' WHEN action IN ('EVENT_SENDTO', 'EVENT_SENDMSG', 'EVENT_CONNECT') THEN 'send' ELSE 'spawn' END AS family FROM flow f""",
    "node_evidence": """
SELECT t.host, t.node_id, max(t.kind) AS kind, max(t.score) AS max_score, count_if(t.score >= a.thr) AS n_high, sum(greatest(t.score - a.thr * 0.5, 0.0)) AS soft, count(*) AS n, sum(t.as_src) AS n_src, sum(t.as_dst) AS n_dst, count(DISTINCT t.peer) AS peers, count(DISTINCT t.action) AS actions,
  bit_or(CASE t.peer_kind WHEN 'process' THEN 1 WHEN 'file' THEN 2 ELSE 4 END) AS peer_mask, avg(t.score) AS mean_score, stddev_pop(t.score) AS std_score FROM touch t JOIN action_thresholds a ON a.action = t.action WHERE t.split = 'test' GROUP BY t.host, t.node_id""",
    "evidence_stats": "SELECT host, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(n AS DOUBLE)) AS med_n, percentile_cont(0.9) WITHIN GROUP (ORDER BY CAST(n AS DOUBLE)) AS q90_n, max(soft) AS max_soft FROM node_evidence GROUP BY host",
    "evidence_ranked": "SELECT e.*, s.med_n, s.q90_n, s.max_soft, row_number() OVER (PARTITION BY e.host ORDER BY max_score DESC, node_id) AS rk FROM node_evidence e JOIN evidence_stats s ON s.host = e.host",
}

TEXTS: dict[str, str] = {
    # counts
    "split_node_overlap": """
WITH n AS (SELECT node_id, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a, max(CASE WHEN split = 'validation' THEN 1 ELSE 0 END) AS b, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS c FROM touch GROUP BY node_id)
SELECT count(*) AS n_nodes, count_if(a = 1) AS in_train, count_if(b = 1) AS in_validation, count_if(c = 1) AS in_test, count_if(a + b = 2) AS train_validation, count_if(a + c = 2) AS train_test, count_if(b + c = 2) AS validation_test, count_if(a + b + c = 3) AS in_all, count_if(c = 1 AND a + b = 0) AS test_only, count(*) * 256 AS state_bytes FROM n""",
    "node_mixing": """
WITH p AS (SELECT host, node_id, action, count(*) AS c FROM touch GROUP BY host, node_id, action), t AS (SELECT host, node_id, sum(c) AS n FROM p GROUP BY host, node_id),
d AS (SELECT host, node_id, count(DISTINCT peer) AS neighbours, count(DISTINCT kind) AS kinds FROM touch GROUP BY host, node_id)
SELECT p.host, p.node_id, CAST(max(t.n) AS BIGINT) AS n_events, max(d.neighbours) AS neighbours, round(abs(sum(-(c / CAST(t.n AS DOUBLE)) * log2(c / CAST(t.n AS DOUBLE)))), 6) AS action_entropy, max(d.kinds) > 1 AS collision
FROM p JOIN t ON t.host = p.host AND t.node_id = p.node_id JOIN d ON d.host = p.host AND d.node_id = p.node_id GROUP BY p.host, p.node_id""",
    "split_mixing_summary": """
WITH c AS (SELECT split, node_id, count(*) AS n FROM touch GROUP BY split, node_id), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n, node_id) - 1 AS r, count(*) OVER (PARTITION BY split) AS m FROM c)
SELECT split, max(m) AS n_nodes, max(CASE WHEN r = /*spark bround*//*duck round_even*/(0.5E0 * (m - 1), 0) THEN n END) AS p50, max(CASE WHEN r = /*spark bround*//*duck round_even*/(0.9E0 * (m - 1), 0) THEN n END) AS p90, round(avg(CASE WHEN n < 3 THEN 1.0E0 ELSE 0.0E0 END), 9) AS low_support FROM r GROUP BY split""",
    "token_frequency": "SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS place FROM train_vocab",
    "frozen_vocab": "SELECT v.token, v.n, coalesce(f.rid, 0) AS token_id FROM train_vocab v LEFT JOIN frozen f ON f.token = v.token",
    "unk_rates": """
SELECT t.host, t.split, count(*) AS n, count_if(f.rid IS NULL) AS n_unknown, round(avg(CASE WHEN f.rid IS NULL THEN 1.0E0 ELSE 0.0E0 END), 9) AS unknown_rate FROM event_tokens t LEFT JOIN frozen f ON f.token = t.token GROUP BY t.host, t.split""",
    "token_coverage": """
WITH n AS (SELECT t.split, t.node_id, w.token, CASE WHEN v.token IS NULL THEN 1 ELSE 0 END AS oov FROM (SELECT DISTINCT split, node_id FROM touch) t JOIN node_tokens w ON w.node_id = t.node_id LEFT JOIN train_vocab v ON v.token = w.token),
g AS (SELECT split, node_id, count(*) AS k, sum(oov) AS o FROM n GROUP BY split, node_id)
SELECT split, count(*) AS nodes, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(o) AS BIGINT) AS oov_tokens, count_if(o = k) AS all_oov, count_if(o > 0 AND o < k) AS partial_oov FROM g GROUP BY split""",
    "conditional_nll_counts": """
WITH a AS (SELECT src_kind, action, count(*) AS c FROM train_flow GROUP BY src_kind, action), s AS (SELECT src_kind, count(*) AS n FROM train_flow GROUP BY src_kind),
d AS (SELECT src_kind, action, dst_kind, count(*) AS c FROM train_flow GROUP BY src_kind, action, dst_kind), g AS (SELECT dst_kind, count(*) AS c FROM train_flow GROUP BY dst_kind), t AS (SELECT count(*) AS n FROM train_flow)
SELECT f.host, f.event_id, round(-ln((coalesce(a.c, 0) + 1.0E0) / (coalesce(s.n, 0) + 10.0E0)), 9) AS action_nll,
  round(-ln(CASE WHEN a.c IS NULL THEN (coalesce(g.c, 0) + 1.0E0) / (t.n + 3.0E0) ELSE (coalesce(d.c, 0) + 1.0E0) / (a.c + 3.0E0) END), 9) AS dst_kind_nll
FROM flow f CROSS JOIN t LEFT JOIN a ON a.src_kind = f.src_kind AND a.action = f.action LEFT JOIN s ON s.src_kind = f.src_kind LEFT JOIN d ON d.src_kind = f.src_kind AND d.action = f.action AND d.dst_kind = f.dst_kind LEFT JOIN g ON g.dst_kind = f.dst_kind WHERE f.split = 'test'""",
    "field_context_nll": """
WITH tok AS (SELECT f.split, f.host, f.event_id, f.action, w.token FROM flow f JOIN node_tokens w ON w.node_id = f.info_dst), p AS (SELECT action, token, count(*) AS c FROM tok WHERE split = 'train' GROUP BY action, token), x AS (SELECT action, count(*) AS n, count(DISTINCT token) AS v FROM tok WHERE split = 'train' GROUP BY action)
SELECT t.host, t.event_id, round(avg(least(20.0E0, -ln((coalesce(p.c, 0) + 1.0E0) / (x.n + x.v)))) + 1.5E0 * avg(CASE WHEN p.c IS NULL THEN 1.0E0 ELSE 0.0E0 END), 6) AS dst_field_nll, round(max(least(20.0E0, -ln((coalesce(p.c, 0) + 1.0E0) / (x.n + x.v)))), 6) AS worst
FROM tok t JOIN x ON x.action = t.action LEFT JOIN p ON p.action = t.action AND p.token = t.token WHERE t.split = 'test' GROUP BY t.host, t.event_id""",
    "edge_familiarity": """
WITH e AS (SELECT info_src, info_dst, action, count(*) AS c FROM train_flow GROUP BY info_src, info_dst, action), t AS (SELECT count(*) AS n FROM train_flow),
o AS (SELECT host, event_id, info_src, info_dst, action, row_number() OVER (PARTITION BY host, info_src, info_dst, action ORDER BY stream_pos) - 1 AS online FROM flow WHERE split = 'test')
SELECT o.host, o.event_id, round(greatest(ln(1.0E0 + t.n) - ln(1.0E0 + coalesce(e.c, 0) + o.online), 0.0E0), 9) AS surprise FROM o CROSS JOIN t LEFT JOIN e ON e.info_src = o.info_src AND e.info_dst = o.info_dst AND e.action = o.action""",
    "bucket_rarity": """
WITH t AS (SELECT count(*) AS n FROM event_tokens WHERE split = 'train'), b AS (SELECT count(*) AS b FROM train_vocab),
r AS (SELECT x.host, x.event_id, -ln((coalesce(v.n, 0) + 1.0E0) / (t.n + b.b)) AS rarity, CASE WHEN v.n IS NULL THEN 1 ELSE 0 END AS unseen, row_number() OVER (PARTITION BY x.host, x.event_id ORDER BY coalesce(v.n, 0), x.token) AS r FROM event_tokens x CROSS JOIN t CROSS JOIN b LEFT JOIN train_vocab v ON v.token = x.token WHERE x.split = 'test')
SELECT host, event_id, round(avg(rarity), 6) AS mean_rarity, round(max(rarity), 6) AS max_rarity, round(avg(CASE WHEN r <= 3 THEN rarity END), 6) AS top3_rarity, CAST(sum(unseen) AS BIGINT) AS unseen FROM r GROUP BY host, event_id""",
    "profile_rarity": """
WITH t AS (SELECT count(*) AS n FROM train_flow), s AS (SELECT info_src, count(*) AS c FROM train_flow GROUP BY info_src), d AS (SELECT info_dst, count(*) AS c FROM train_flow GROUP BY info_dst), e AS (SELECT info_src, info_dst, count(*) AS c FROM train_flow GROUP BY info_src, info_dst), r AS (SELECT action, dst_kind, count(*) AS c FROM train_flow GROUP BY action, dst_kind),
o AS (SELECT node, sum(c) AS c FROM (SELECT info_src AS node, c FROM s UNION ALL SELECT info_dst, c FROM d) u GROUP BY node)
SELECT f.host, f.event_id, round(-ln((coalesce(e.c, 0) + 1.0E0) / (t.n + 1)), 9) AS edge_rarity, round(-ln((coalesce(s.c, 0) + 1.0E0) / (t.n + 1)), 9) AS src_rarity, round(-ln((coalesce(d.c, 0) + 1.0E0) / (t.n + 1)), 9) AS dst_rarity, round(-ln((coalesce(r.c, 0) + 1.0E0) / (t.n + 1)), 9) AS relation_rarity,
  round(-ln((coalesce(os.c, 0) + 1.0E0) / (2 * t.n + 1)), 9) AS src_self_rarity, round(-ln((coalesce(od.c, 0) + 1.0E0) / (2 * t.n + 1)), 9) AS dst_self_rarity,
  round(-ln((least(coalesce(os.c, 0), coalesce(od.c, 0)) + 1.0E0) / (2 * t.n + 1)), 9) AS endpoint_self_rarity
FROM flow f CROSS JOIN t LEFT JOIN o os ON os.node = f.info_src LEFT JOIN o od ON od.node = f.info_dst LEFT JOIN s ON s.info_src = f.info_src LEFT JOIN d ON d.info_dst = f.info_dst LEFT JOIN e ON e.info_src = f.info_src AND e.info_dst = f.info_dst LEFT JOIN r ON r.action = f.action AND r.dst_kind = f.dst_kind WHERE f.split = 'test'""",
    "process_semantic_audit": """
WITH s AS (SELECT f.split, w.tokens, f.event_id FROM flow f JOIN node_words w ON w.node_id = f.actor_id), c AS (SELECT split, tokens, count(*) AS n, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, tokens) AS r FROM s GROUP BY split, tokens), t AS (SELECT split, count(*) AS events, count_if(tokens = 'unknown') AS unknown, count(DISTINCT tokens) AS roles FROM s GROUP BY split)
SELECT c.split, t.events, t.unknown, t.roles, c.r, c.tokens, c.n FROM c JOIN t ON t.split = c.split WHERE c.r <= 20""",
    "collision_audit": "SELECT w.tokens, count(DISTINCT coalesce(n.path, n.dst_addr)) AS raw_values, count(DISTINCT n.node_id) AS nodes, count(t.event_id) AS train_refs FROM node_words w JOIN prov_nodes n ON n.node_id = w.node_id LEFT JOIN (SELECT node_id, event_id FROM touch WHERE split = 'train') t ON t.node_id = n.node_id GROUP BY w.tokens",
    "temporal_count_score": """
WITH a AS (SELECT src_kind, action, count(*) AS c FROM train_flow GROUP BY src_kind, action), s AS (SELECT src_kind, count(*) AS n FROM train_flow GROUP BY src_kind), e AS (SELECT info_src, info_dst, count(*) AS c FROM train_flow GROUP BY info_src, info_dst), t AS (SELECT count(*) AS n FROM train_flow),
x AS (SELECT f.host, f.event_id, -ln((coalesce(a.c, 0) + 1.0E0) / (coalesce(s.n, 0) + 10.0E0)) AS action_nll, ln(1.0E0 + t.n) - ln(1.0E0 + coalesce(e.c, 0)) AS edge FROM flow f CROSS JOIN t LEFT JOIN a ON a.src_kind = f.src_kind AND a.action = f.action LEFT JOIN s ON s.src_kind = f.src_kind LEFT JOIN e ON e.info_src = f.info_src AND e.info_dst = f.info_dst WHERE f.split = 'test')
SELECT host, event_id, round(action_nll + edge, 6) AS score, CASE WHEN action_nll >= edge THEN 'action' ELSE 'edge' END AS top_component FROM x""",
    "latent_dim_from_vocab": "SELECT n, CASE WHEN n < 100 THEN 32 WHEN n < 1000 THEN 64 WHEN n < 10000 THEN 128 ELSE 256 END AS latent_dim FROM (SELECT count(*) AS n FROM train_vocab) x",
    # ordered windows
    "stream_pos": "SELECT host, event_id, ts_us, stream_pos FROM flow",
    "node_counts_before": "SELECT host, stream_pos, node_id, n_before, CAST(src_before AS BIGINT) AS src_before, CAST(dst_before AS BIGINT) AS dst_before FROM touch_before",
    "edge_novelty": "SELECT f.host, f.event_id, CASE WHEN row_number() OVER (PARTITION BY f.host, info_src, info_dst, family ORDER BY stream_pos) = 1 THEN round(greatest(score - a.thr, 0.0E0), 6) ELSE 0.0E0 END AS excess FROM families f JOIN action_thresholds a ON a.action = f.action",
    "recent_distinct_peers": """
SELECT a.host, a.stream_pos, a.node_id, count(DISTINCT b.peer) AS recent_peers FROM touch a LEFT JOIN touch b ON b.host = a.host AND b.node_id = a.node_id AND b.stream_pos < a.stream_pos AND b.ts_us >= a.ts_us - 2592000000000 GROUP BY a.host, a.stream_pos, a.node_id""",
    "recent_chain_diversity": """
SELECT a.host, a.stream_pos, a.node_id, count(DISTINCT b.peer_kind) AS kinds, count(DISTINCT b.action) AS actions, count(DISTINCT concat(b.kind, b.action, b.peer_kind)) AS transitions FROM touch a JOIN touch b ON b.host = a.host AND b.node_id = a.node_id AND b.stream_pos <= a.stream_pos AND b.ts_us >= a.ts_us - 2592000000000 GROUP BY a.host, a.stream_pos, a.node_id""",
    "chain_transition_rarity": """
WITH e AS (SELECT host, stream_pos, event_id, ts_us, split, info_src, info_dst, concat(action, '|', src_kind, '|', dst_kind) AS role, concat(CAST(info_src AS STRING), '>', CAST(info_dst AS STRING)) AS pair FROM flow),
n AS (
  SELECT host, stream_pos, event_id, ts_us, split, role, info_src AS node_id, CASE WHEN info_src = info_dst THEN 'SD' ELSE 'S' END AS sides FROM e
  UNION ALL SELECT host, stream_pos, event_id, ts_us, split, role, info_dst, 'D' FROM e WHERE info_src <> info_dst),
l AS (SELECT host, event_id, ts_us, split, role, sides, lag(role, 1) OVER w AS b, lag(ts_us, 1) OVER w AS us, 0 AS slot FROM n WINDOW w AS (PARTITION BY host, node_id ORDER BY stream_pos) UNION ALL SELECT host, event_id, ts_us, split, role, sides, lag(role, 2) OVER w AS b, lag(ts_us, 2) OVER w AS us, 1 AS slot FROM n WINDOW w AS (PARTITION BY host, node_id ORDER BY stream_pos) UNION ALL SELECT host, event_id, ts_us, split, role, sides, lag(role, 3) OVER w AS b, lag(ts_us, 3) OVER w AS us, 2 AS slot FROM n WINDOW w AS (PARTITION BY host, node_id ORDER BY stream_pos) UNION ALL SELECT host, event_id, ts_us, split, role, sides, lag(role, 4) OVER w AS b, lag(ts_us, 4) OVER w AS us, 3 AS slot FROM n WINDOW w AS (PARTITION BY host, node_id ORDER BY stream_pos)),
k AS (
  SELECT host, event_id, split, b, role, slot, length(bin(CAST(floor((ts_us - us) / 1000000.0E0) AS BIGINT) + 1)) - 1 AS g, side.x AS side
  FROM l JOIN (SELECT 'S' AS x UNION ALL SELECT 'D') side ON l.sides LIKE concat('%', side.x, '%') WHERE b IS NOT NULL),
j AS (SELECT host, event_id, split, concat(side, '|', b, '|', role, '|', CAST(CASE WHEN g > 24 THEN 24 ELSE g END AS STRING), '|', CAST(slot AS STRING)) AS key FROM k),
c AS (SELECT key, count(*) AS c FROM j WHERE split = 'train' GROUP BY key),
t AS (SELECT coalesce(sum(c), 0) AS n FROM c),
m AS (
  SELECT j.host, j.event_id, max(-ln((coalesce(c.c, 0) + 1.0E0) / (t.n + 100))) AS tr, avg(-ln((coalesce(c.c, 0) + 1.0E0) / (t.n + 100))) AS tm
  FROM j CROSS JOIN t LEFT JOIN c ON c.key = j.key WHERE j.split = 'test' GROUP BY j.host, j.event_id),
rp AS (SELECT pair, count(*) AS c FROM e WHERE split = 'train' GROUP BY pair),
re AS (SELECT role, pair, count(*) AS c FROM e WHERE split = 'train' GROUP BY role, pair),
rr AS (SELECT role, count(*) AS c FROM e WHERE split = 'train' GROUP BY role),
nt AS (SELECT count(*) AS n FROM e WHERE split = 'train'),
x AS (
  SELECT e.host, e.event_id, -ln((coalesce(rp.c, 0) + 1.0E0) / (nt.n + 100)) AS p, -ln((coalesce(re.c, 0) + 1.0E0) / (nt.n + 100)) AS d, -ln((coalesce(rr.c, 0) + 1.0E0) / (nt.n + 100)) AS r, m.tr, m.tm
  FROM e CROSS JOIN nt LEFT JOIN rp ON rp.pair = e.pair LEFT JOIN re ON re.pair = e.pair AND re.role = e.role LEFT JOIN rr ON rr.role = e.role
  LEFT JOIN m ON m.host = e.host AND m.event_id = e.event_id WHERE e.split = 'test'),
y AS (SELECT x.*, CASE WHEN tr IS NULL THEN 0.0E0 ELSE greatest(tr - 0.5E0 * greatest(r, d), 0.0E0) END AS disc FROM x)
SELECT host, event_id, round(p, 6) AS pair_rarity, round(d, 6) AS edge_rarity, round(r, 6) AS role_rarity, round(coalesce(tr, 0.0E0), 6) AS max_rarity, round(coalesce(tm, 0.0E0), 6) AS mean_rarity, round(disc, 6) AS discrepancy,
  round(CASE WHEN tr IS NULL THEN 0.45E0 * p + 0.15E0 * d + 0.4E0 * r
    ELSE 0.65E0 * (0.2E0 * p + 0.1E0 * d + 0.1E0 * r + 0.6E0 * tr) + 0.35E0 * (0.7E0 * disc + 0.2E0 * tm + 0.1E0 * p) END, 6) AS chain_score FROM y""",
    "time_gaps": """
SELECT host, event_id, round(coalesce(ln(1 + (ts_us - lag(ts_us) OVER (PARTITION BY host ORDER BY stream_pos)) / 1000000.0E0), 0.0E0), 6) AS global_gap, round(coalesce(ln(1 + (ts_us - lag(ts_us) OVER (PARTITION BY host, info_src ORDER BY stream_pos)) / 1000000.0E0), 0.0E0), 6) AS src_gap,
  round(coalesce(ln(1 + (ts_us - lag(ts_us) OVER (PARTITION BY host, info_src, info_dst ORDER BY stream_pos)) / 1000000.0E0), 0.0E0), 6) AS edge_gap FROM flow""",
    "decayed_max": """
SELECT host, stream_pos, node_id, round(exp(max(ln(score) + (ts_us - 788918400000000) / 31536000000000.0E0) OVER (PARTITION BY host, node_id ORDER BY stream_pos) - (ts_us - 788918400000000) / 31536000000000.0E0), 4) AS decayed FROM touch WHERE score > 0""",
    "node_pool_checkpoints": """
WITH r AS (SELECT host, stream_pos, node_id, sum(score) OVER (PARTITION BY host, node_id ORDER BY stream_pos) AS pool FROM touch WHERE split = 'test')
SELECT host, CAST(floor(stream_pos / 1000.0E0) AS BIGINT) AS checkpoint, round(max(pool), 4) AS best_score, /*spark max_by(node_id, struct(pool, node_id))*//*duck max({'p': pool, 'n': node_id}).n*/ AS best_node, count(DISTINCT node_id) AS active_nodes FROM r GROUP BY host, CAST(floor(stream_pos / 1000.0E0) AS BIGINT)""",
    "first_alert_per_node": "SELECT host, node_id, event_id, stream_pos, score FROM (SELECT t.*, row_number() OVER (PARTITION BY host, node_id ORDER BY stream_pos) AS r FROM alert_touch t) x WHERE r = 1",
    "has_state_before": "SELECT host, stream_pos, node_id, is_active FROM active",
    # attribute jobs
    "path_tokens": f"""
SELECT path, array_to_string(CASE WHEN len(s) = 0 THEN ['PATH_na'] ELSE list_filter([concat('ROOT_', CASE WHEN starts_with(c, '/') THEN {piece('s[1]', 'root')} ELSE 'rel' END),
  CASE WHEN len(s) >= 2 THEN concat('DIR_', {piece('s[len(s) - 1]', 'dir', 20)}) END, concat('PATH_', {base_signature('s[len(s)]')})], lambda x: x IS NOT NULL) END, ' ') AS tokens
FROM (SELECT path, c, list_filter(string_split(c, '/'), lambda x: x <> '') AS s FROM (SELECT DISTINCT path, trim(regexp_replace(replace(trim(path), chr(92), '/'), '/+', '/', 'g')) AS c FROM prov_nodes WHERE path IS NOT NULL) x) y""",
    "value_signature": f"""
SELECT v, CASE WHEN t = '' THEN 'na' WHEN lower(t) IN ('true', 'false') THEN lower(t) WHEN regexp_matches(t, '^[0-9]+$') THEN {bucket('N', 'CAST(t AS HUGEINT)')}
  WHEN contains(t, '/') OR contains(t, chr(92)) THEN CASE WHEN s[len(s)] IS NULL THEN 'path' ELSE {base_signature('s[len(s)]')} END
  WHEN contains(t, '|') OR contains(t, ';') THEN {bucket('L', "greatest(len(list_filter(regexp_split_to_array(t, '[|;,]+'), lambda x: x <> '')), 1)")}
  WHEN contains(t, ':') AND NOT starts_with(t, 'http') AND len(list_filter(string_split(t, ':'), lambda x: x <> '')) > 2 THEN {bucket('L', "len(list_filter(string_split(t, ':'), lambda x: x <> ''))")}
  WHEN regexp_matches(t, '^(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])([.](0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){{3}}$') THEN concat('IP_', replace(t, '.', '_')) ELSE {piece('t', 'val', 24)} END AS signature
FROM (SELECT v, trim(v) AS t, list_filter(string_split(replace(trim(v), chr(92), '/'), '/'), lambda x: x <> '') AS s FROM (SELECT dst_addr AS v FROM prov_nodes UNION SELECT dst_port FROM prov_nodes UNION SELECT path FROM prov_nodes UNION SELECT cmd FROM prov_nodes) x WHERE v IS NOT NULL) y""",
    "netflow_tokens": "SELECT DISTINCT concat('IP_', replace(dst_addr, '.', '_')) AS ip_token, concat('PORT_', dst_port) AS port_token FROM prov_nodes WHERE kind = 'netflow'",
    "ip_scope": """
SELECT dst_addr, dst_port, CASE WHEN dst_addr = '0.0.0.0' THEN 'zero' WHEN a = 127 THEN 'loopback' WHEN a = 128 AND b = 55 THEN concat('internal_', CAST(c AS STRING)) WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private' ELSE 'public' END AS scope,
  CASE WHEN CAST(dst_port AS INT) < 1024 THEN 'system' WHEN CAST(dst_port AS INT) < 49152 THEN 'registered' ELSE 'ephemeral' END AS port_bucket FROM (
  SELECT DISTINCT dst_addr, dst_port, CAST(split_part(dst_addr, '.', 1) AS INT) AS a, CAST(split_part(dst_addr, '.', 2) AS INT) AS b, CAST(split_part(dst_addr, '.', 3) AS INT) AS c FROM prov_nodes WHERE kind = 'netflow') x""",
    "semantic_profile_route": "SELECT DISTINCT host, CASE WHEN host LIKE 'h0%' THEN 'freebsd' WHEN host LIKE 'h1%' THEN 'linux' WHEN host LIKE 'h2%' THEN 'android' ELSE 'generic' END AS profile FROM prov_events",
    "node_roles": "SELECT node_id, array_to_string(list_prepend(kind, CASE WHEN kind = 'netflow' THEN tokens ELSE tokens[1:2] END), '|') AS role FROM node_summaries",
    "coarse_raw_roles": """
SELECT node_id, CASE WHEN kind = 'netflow' THEN array_to_string(list_prepend(kind, tokens), '|') WHEN kind = 'file' THEN CASE WHEN r IS NULL AND d IS NULL THEN 'file|coarse_path' ELSE concat_ws('|', 'file', r, d) END ELSE concat_ws('|', 'process', coalesce(d, 'coarse_process')) END AS coarse_role,
  CASE WHEN kind = 'netflow' THEN array_to_string(list_prepend(kind, tokens), '|') WHEN kind = 'file' THEN concat_ws('|', 'file', r, d, coalesce(p, tokens[1])) ELSE concat_ws('|', 'process', coalesce(e, tokens[1]), d) END AS raw_role
FROM (SELECT *, list_filter(tokens, lambda x: starts_with(x, 'root_'))[1] AS r, list_filter(tokens, lambda x: starts_with(x, 'dir_'))[1] AS d, list_filter(tokens, lambda x: starts_with(x, 'path_'))[1] AS p, list_filter(tokens, lambda x: starts_with(x, 'exe_'))[1] AS e FROM node_summaries) z""",
    "endpoint_signature": "SELECT node_id, CASE WHEN dst_addr IS NOT NULL THEN concat(dst_addr, ':', coalesce(dst_port, '')) ELSE concat('node:', CAST(node_id AS STRING)) END AS signature FROM prov_nodes",
    "flow_gates": """
SELECT f.host, f.event_id, round(g.lam * s.scale, 9) AS gate_lambda, round(g.rho * s.scale, 9) AS gate_rho FROM flow f
JOIN (SELECT action, lam, rho FROM (VALUES ('EVENT_CLONE', 0.4E0, 0.2E0), ('EVENT_CONNECT', 0.5E0, 0.2E0), ('EVENT_EXECUTE', 0.5E0, 0.2E0), ('EVENT_OPEN', 0.1E0, 0.05E0), ('EVENT_READ', 0.1E0, 0.05E0), ('EVENT_RECVFROM', 0.1E0, 0.05E0), ('EVENT_RECVMSG', 0.1E0, 0.05E0), ('EVENT_SENDMSG', 0.5E0, 0.2E0), ('EVENT_SENDTO', 0.5E0, 0.2E0), ('EVENT_WRITE', 0.5E0, 0.2E0)) v(action, lam, rho)) g ON g.action = f.action
JOIN (SELECT kind, scale FROM (VALUES ('process', 1.0E0), ('file', 0.3E0), ('netflow', 0.3E0), ('unknown', 0.1E0)) w(kind, scale)) s ON s.kind = f.src_kind""",
    # node ranking
    "node_score": "SELECT host, node_id, round(max_score + 2 * ln(1.0E0 + n_high) + 0.5E0 * ln(1.0E0 + soft), 4) AS node_score FROM node_evidence",
    "node_features": "SELECT host, node_id, kind, max_score, n_high, round(soft, 4) AS soft, n, CAST(n_src AS BIGINT) AS n_src, CAST(n_dst AS BIGINT) AS n_dst, peers, actions, bit_count(peer_mask) AS peer_kinds, round(mean_score, 4) AS mean_score, round(1 / (1 + std_score / greatest(abs(mean_score), 0.000000001E0)), 6) AS stability, round(least(1.0E0, actions / CAST(n AS DOUBLE)), 9) AS chain FROM node_evidence",
    "node_rerank": """
SELECT host, node_id, round(max_score / 1000 + 2 * ln(1.0E0 + n_high) + soft / nullif(max_soft, 0) - CASE WHEN n_src = 0 THEN 1.0E0 ELSE 0.0E0 END - greatest(ln(1.0E0 + n) - ln(1.0E0 + q90_n), 0.0E0), 6) AS reranked FROM evidence_ranked""",
    "activity_normalized_chain": "SELECT host, node_id, rk, round(CASE WHEN rk BETWEEN 21 AND 200 THEN max_score * (1 + 0.1E0 * least(3.0E0, greatest((actions * 1.0E0 / n) / (10.0E0 / med_n) - 1, 0.0E0))) ELSE max_score END, 4) AS boosted FROM evidence_ranked",
    "closure_score": "SELECT host, node_id, rk, round(max_score + CASE WHEN rk BETWEEN 21 AND 300 THEN 100.0E0 * (bit_count(peer_mask) - 1) + CASE WHEN n_src > 0 AND n_dst > 0 THEN 50.0E0 ELSE -50.0E0 END ELSE 0.0E0 END, 4) AS closure FROM evidence_ranked",
    "evidence_band_gate": """
SELECT host, node_id, rk, families, round(max_score * CASE WHEN rk BETWEEN 51 AND 500 THEN CASE WHEN families >= 3 THEN 1.05E0 WHEN families = 2 THEN 1.0E0 ELSE 0.95E0 END ELSE 1.0E0 END, 4) AS gated FROM (
  SELECT *, CASE WHEN n_high > 0 THEN 1 ELSE 0 END + CASE WHEN peers >= 3 THEN 1 ELSE 0 END + CASE WHEN actions >= 3 THEN 1 ELSE 0 END + CASE WHEN bit_count(peer_mask) >= 2 THEN 1 ELSE 0 END AS families FROM evidence_ranked) x""",
    "mid_rank_gate": "SELECT host, node_id, rk, round(CASE WHEN rk BETWEEN 101 AND 1000 AND n_high = 0 AND peers < 2 THEN max_score * 0.9E0 ELSE max_score END, 4) AS gated FROM evidence_ranked",
    "local_closure": "SELECT host, node_id, rk, round(least(ln(1.0E0 + peers), least(ln(1.0E0 + actions), ln(1.0E0 + n_high))), 6) AS core, rk BETWEEN 11 AND 500 AND peers >= 2 AND actions >= 2 AND n_high >= 1 AS passes FROM evidence_ranked",
    # vectors
    "distance": """
WITH v AS (SELECT vec_id, pos, x FROM (SELECT vec_id, embedding FROM embeddings) e /*spark LATERAL VIEW posexplode(embedding) t AS pos, x*//*duck , LATERAL (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding) AS x) t*/)
SELECT a.vec_id, round(1 - sum(CAST(a.x AS DOUBLE) * b.x) / greatest(sqrt(sum(CAST(a.x AS DOUBLE) * a.x)) * sqrt(sum(CAST(b.x AS DOUBLE) * b.x)), 0.00000001E0), 5) AS cosine_distance, round(avg((CAST(a.x AS DOUBLE) - b.x) * (CAST(a.x AS DOUBLE) - b.x)), 6) AS mse FROM v a JOIN v b ON b.vec_id = a.vec_id - a.vec_id % 10 AND b.pos = a.pos GROUP BY a.vec_id""",
    "action_residual_variance": """
WITH r AS (SELECT e.label AS action_id, t.pos, CAST(t.x AS DOUBLE) AS x FROM embeddings e /*spark LATERAL VIEW posexplode(embedding) t AS pos, x*//*duck , LATERAL (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding) AS x) t*/),
g AS (SELECT pos, var_samp(x) AS gv FROM r GROUP BY pos) SELECT r.action_id, r.pos, count(*) AS n, round(CASE WHEN count(*) < 30 THEN max(g.gv) ELSE greatest(var_samp(x), 0.000001E0) END, 8) AS variance FROM r JOIN g ON g.pos = r.pos GROUP BY r.action_id, r.pos""",
}
