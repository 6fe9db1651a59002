"""Classes of nodes under each system's rules, and score arithmetic over vectors."""

from __future__ import annotations

from tracewell.functions.android_details import FAMILIES, FENNEC, PACKAGES, rule_rows
from tracewell.functions.node_rules import defaults_sql, rules_sql
from tracewell.operators import details

_STARTS, _ENDS, _MATCHES = "/*spark startswith*//*duck starts_with*/", "/*spark endswith*//*duck ends_with*/", "/*spark regexp_like*//*duck regexp_matches*/"
_DIMS = "/*spark LATERAL VIEW posexplode(embedding) t AS pos, x*//*duck , LATERAL (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding) AS x) t*/"



def _token(x: str, most: int = 60) -> str:
    plain = f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '\\s+', '_', 'g'), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"substr(coalesce(nullif({plain}, ''), 'unknown'), 1, {most})"


_GENERIC, _MISSING = (", ".join(f"'{x}'" for x in names) for names in (details.GENERIC, details.MISSING))
#: what a file of /proc/<number> is of, from the list q of its further parts
_OF_PROCESS = {
    "freebsd": _token("q[-1]"),
    "linux": f"CASE WHEN q[1] = 'fd' THEN 'fd' WHEN q[1] = 'task' AND len(q) >= 3 THEN concat('task_', {_token('q[3]', 40)}) ELSE {_token('q[1]', 40)} END",
}


def _file_details(system: str) -> str:
    own = "WHEN cut = '0' THEN 'swapper' " if system == "linux" else ""
    return f"""
WITH f AS (SELECT DISTINCT path, class, lower(trim(path)) AS low, rtrim(lower(trim(path)), '/') AS cut FROM node_classes WHERE kind = 'file' AND system = '{system}'),
g AS (SELECT *, string_split(cut, '/')[-1] AS last, regexp_extract(cut, '([^/]+)/+[^/]*$', 1) AS above, list_filter(string_split(regexp_replace(cut, '^/proc/[0-9]+', ''), '/'), lambda z: z <> '') AS q FROM f),
h AS (SELECT *, {_token('last')} AS name, {_token('above')} AS parent FROM g)
SELECT path, class, CASE WHEN low IN ({_MISSING}) THEN 'unknown' WHEN class = 'filesystem_root' THEN 'root' WHEN class IN ('freebsd_root_dir', 'linux_root_dir') THEN {_token("concat(split_part(ltrim(low, '/'), '/', 1), '_root')")}
  WHEN class = 'proc_cmdline' THEN 'cmdline' WHEN regexp_matches(cut, '^/proc/[0-9]+(/|$)') THEN CASE WHEN len(q) = 0 THEN 'proc' ELSE {_OF_PROCESS[system]} END {own}
  WHEN name IN ({_GENERIC}) AND above <> '' AND NOT regexp_full_match(parent, '[0-9]+') THEN substr(concat(parent, '_', name), 1, 60) ELSE name END AS detail FROM h"""


#: addresses of the given tables are IPv4, so both systems have the same scopes
_NETFLOWS = """
WITH a AS (SELECT node_id, dst_addr, list_transform(string_split(dst_addr, '.'), lambda z: CAST(z AS INTEGER)) AS o, CAST(dst_port AS BIGINT) AS port FROM prov_nodes WHERE kind = 'netflow'),
s AS (SELECT *, CASE WHEN o[1] = 0 THEN 'ip_unknown_or_zero' WHEN o[1] = 127 THEN 'ip_loopback' WHEN o[1] = 128 AND o[2] = 55 AND o[3] = 12 THEN 'ip_internal_env'
  WHEN o[1] = 10 OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) THEN 'ip_private' ELSE 'ip_public_or_external' END AS scope FROM a)
SELECT node_id, concat('net|', scope, CASE WHEN port <= 0 THEN '|port_unknown_or_zero' WHEN port < 1024 THEN '|port_system' WHEN port < 49152 THEN '|port_registered' WHEN port < 65536 THEN '|port_ephemeral' ELSE '|port_invalid' END) AS role,
  CASE WHEN scope = 'ip_unknown_or_zero' THEN 'netflow' ELSE concat_ws(' ', 'netflow', scope, replace(dst_addr, '.', '_')) END AS tokens FROM s"""

def _squeezed(x: str, most: int = 80) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({_token(x, most)}, '_+', '_', 'g'), '^_|_$', '', 'g'), ''), 'unknown')"


def _phone_rules(mode: str) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quote, r))})" for r in rule_rows(mode))


def _phone_families(x: str, word) -> str:
    return " ".join(f"WHEN starts_with({x}, '{f}') THEN concat('{f.replace('.', '_')}', {word(f'substr({x}, {len(f) + 1})', 40)})" for f in FAMILIES)


def _phone_files(mode: str) -> str:
    """Rules as a table: the first that fits a path of its class."""
    refined = mode == "refined"
    old = f"CASE WHEN starts_with(package, 'org.mozilla.') THEN 'org_mozilla' WHEN starts_with(package, 'com.android.email') THEN 'com_android_email' {_phone_families('package', _token)} WHEN package = '' THEN 'app' ELSE {_token('package', 40)} END"
    new = f"CASE WHEN cut = 'org.mozilla.{FENNEC}' THEN '{FENNEC}' {_phone_families('cut', _squeezed)} WHEN cut = '' THEN 'app' ELSE {_squeezed('cut', 50)} END"
    kin = f"CASE WHEN class IN ('android_app_private_file', 'android_app_cache_file') THEN {new} ELSE {old} END" if refined else old
    said = f"CASE WHEN class IN ('android_device_file', 'android_socket_file') THEN {_squeezed('name', 40)} ELSE name END" if refined else "name"
    return f"""
WITH r AS (SELECT * FROM (VALUES {_phone_rules(mode)}) v(place, class, how, value, detail)),
f AS (SELECT DISTINCT path FROM phone_nodes WHERE kind = 'file'),
c AS (SELECT path, lower(path) AS low, coalesce(min_by(x.label, x.place), 'file_other') AS class FROM f LEFT JOIN class_rules x ON x.system = 'android' AND x.kind = 'file' AND CASE x.how WHEN 'is' THEN lower(path) = x.value
  WHEN 'start' THEN starts_with(lower(path), x.value) WHEN 'end' THEN ends_with(lower(path), x.value) WHEN 'match' THEN regexp_matches(lower(path), x.value) ELSE FALSE END GROUP BY path),
p AS (SELECT *, regexp_extract(low, '([^/]*)/*$', 1) AS name, coalesce(nullif(regexp_extract(low, '/data/data/([^/]+)', 1), ''), regexp_extract(low, '/android/data/([^/]+)', 1)) AS package FROM c),
q AS (SELECT *, regexp_replace(coalesce(nullif(package, ''), regexp_extract(low, '/data/app/([^/]+)', 1)), '-[^-]*$', '') AS cut FROM p),
k AS (SELECT *, {kin} AS family, {said} AS said, {_squeezed("regexp_extract(low, '^/data/data/[^/]+/([^/]+)', 1)", 40)} AS sub FROM q)
SELECT k.path, k.class, replace(replace(min_by(r.detail, r.place), '{{family}}', max(k.family)), '{{name}}', max({_token('k.name')})) AS detail FROM k JOIN r ON r.class = k.class AND CASE r.how WHEN 'any' THEN TRUE WHEN 'is' THEN low = r.value
  WHEN 'start' THEN starts_with(low, r.value) WHEN 'end' THEN ends_with(low, r.value) WHEN 'has' THEN contains(low, r.value) WHEN 'match' THEN regexp_matches(low, r.value) WHEN 'name' THEN said = r.value WHEN 'namestart' THEN starts_with(said, r.value)
  WHEN 'nameend' THEN ends_with(said, r.value) WHEN 'namematch' THEN regexp_matches(said, r.value) WHEN 'folder' THEN ends_with(rtrim(low, '/'), r.value) WHEN 'kin' THEN regexp_matches(concat(family, ' ', low), r.value) ELSE sub = r.value END GROUP BY k.path, k.class"""


def _phone_processes(mode: str) -> str:
    refined = mode == "refined"
    base, word = ("split_part(cmd, ':', 1)", _squeezed) if refined else ("cmd", _token)
    odd = "" if refined else "WHEN contains(base, '.') AND NOT regexp_full_match(base, '[A-Za-z0-9_]+([.][A-Za-z0-9_]+)+') THEN 'unknown' WHEN NOT contains(base, '.') AND NOT regexp_full_match(base, '[A-Za-z0-9_:-]+') THEN 'unknown' "
    labels = " ".join(f"WHEN starts_with(base, '{start}') THEN '{label}'" for label, start in PACKAGES)
    rest = " ".join(f"WHEN class = '{label}' THEN substr(lower(base), {len(start) + 1})" for label, start in PACKAGES)
    said = f"CASE WHEN class = 'package_other' THEN lower(base) {rest} ELSE split_part(lower(base), ' ', 1) END"
    after = "nullif(lower(substr(cmd, strpos(cmd, ':') + 1)), '')" if refined else "NULL"
    whole = word(f"concat_ws('_', nullif(said, ''), CASE WHEN contains(cmd, ':') THEN {after} END)", 60)
    return f"""
WITH b AS (SELECT DISTINCT cmd, coalesce({base}, '') AS base FROM phone_nodes WHERE kind = 'process'),
c AS (SELECT *, CASE WHEN base = '' THEN 'unknown' {odd}{labels} WHEN contains(base, '.') THEN 'package_other' ELSE 'native_process' END AS class FROM b),
d AS (SELECT *, {said} AS said FROM c)
SELECT cmd, class, CASE WHEN class = 'unknown' THEN 'unknown' ELSE {whole} END AS detail FROM d"""


COMMON: dict[str, str] = {
    "phone_nodes": """
SELECT node_id, kind, CASE WHEN kind <> 'file' THEN path WHEN starts_with(path, '/tmp/') THEN concat('/data/local/tmp/', substr(path, 6)) WHEN starts_with(path, '/etc/') THEN concat('/system/etc/', substr(path, 6))
    WHEN starts_with(path, '/var/log/') THEN concat('/data/system/dropbox/', substr(path, 10)) WHEN starts_with(path, '/usr/lib//') THEN concat('/data/data/com.shop/databases/', substr(path, 11))
    WHEN starts_with(path, '/home/u/') THEN concat('/storage/emulated/0/DCIM/', substr(path, 9)) ELSE path END AS path,
  CASE WHEN kind = 'process' AND cmd IS NOT NULL THEN concat(CASE node_id % 4 WHEN 0 THEN 'com.android.providers.' WHEN 1 THEN 'com.google.Apps.' WHEN 2 THEN 'net.tools.' ELSE '' END, split_part(cmd, ' ', 1), CASE WHEN node_id % 3 = 0 THEN ':remote' ELSE '' END) END AS cmd FROM prov_nodes""",
    "class_rules": rules_sql(),
    "class_defaults": defaults_sql(),
    "node_attributes": """
SELECT DISTINCT kind, coalesce(path, '') AS path, coalesce(cmd, '') AS cmd, regexp_replace(lower(regexp_replace(regexp_replace(coalesce(nullif(split_part(cmd, ' ', 1), ''), path, ''), '^.*/', ''), '^-+', '')), '[^a-z0-9]+', '_'/*duck , 'g'*/) AS token,
  regexp_replace(lower(coalesce(path, '')), '/+', '/'/*duck , 'g'*/) AS clean, lower(concat_ws(' ', cmd, path)) AS everything FROM prov_nodes WHERE kind <> 'netflow'""",
    "node_classes": f"""
SELECT a.kind, a.path, a.cmd, d.system, CASE WHEN a.path = '' AND a.cmd = '' THEN max(d.nothing) ELSE coalesce(min_by(r.label, r.place), max(d.other)) END AS class
FROM node_attributes a JOIN class_defaults d ON d.kind = a.kind LEFT JOIN class_rules r ON r.system = d.system AND r.kind = a.kind AND CASE r.how WHEN 'word' THEN a.token = r.value WHEN 'wordstart' THEN {_STARTS}(a.token, r.value)
  WHEN 'is' THEN a.clean = r.value WHEN 'start' THEN {_STARTS}(a.clean, r.value) WHEN 'end' THEN {_ENDS}(a.clean, r.value) WHEN 'match' THEN {_MATCHES}(a.clean, r.value) WHEN 'cmdstart' THEN {_STARTS}(lower(a.cmd), r.value)
  WHEN 'cmdmatch' THEN {_MATCHES}(a.cmd, r.value) ELSE contains(a.everything, r.value) END GROUP BY a.kind, a.path, a.cmd, d.system""",
    "phone_files": _phone_files("refined"),
    "phone_processes": _phone_processes("refined"),
    "vec_pairs": f"""
SELECT a.vec_id, a.label, a.pos, a.x AS p, b.x AS y FROM (SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS x FROM embeddings {_DIMS}) a JOIN (SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM embeddings {_DIMS}) b ON b.vec_id = a.vec_id - a.vec_id % 10 AND b.pos = a.pos""",
}

TEXTS: dict[str, str] = {
    "freebsd_file_details": _file_details("freebsd"),
    "linux_file_details": _file_details("linux"),
    "android_file_details": "SELECT path, class, detail FROM phone_files",
    "android_file_details_legacy": _phone_files("legacy"),
    "android_process_details": "SELECT cmd, class, detail FROM phone_processes",
    "android_process_details_legacy": _phone_processes("legacy"),
    "android_sentence": """
WITH n AS (SELECT p.node_id, CASE p.kind WHEN 'process' THEN concat_ws(' ', 'process', q.class, q.detail) WHEN 'file' THEN concat_ws(' ', 'file', f.class, f.detail) ELSE 'netflow' END AS tokens FROM phone_nodes p
  LEFT JOIN phone_files f ON p.kind = 'file' AND f.path = p.path LEFT JOIN phone_processes q ON p.kind = 'process' AND q.cmd IS NOT DISTINCT FROM p.cmd)
SELECT e.host, e.event_id, concat_ws(' ', s.tokens, 'event', lower(e.action), d.tokens) AS sentence FROM prov_flow e JOIN n s ON s.node_id = e.info_src JOIN n d ON d.node_id = e.info_dst""",
    "freebsd_netflow_tokens": _NETFLOWS,
    "linux_netflow_tokens": _NETFLOWS,
    "freebsd_node_semantics": "SELECT kind, path, cmd, class FROM node_classes WHERE system = 'freebsd'",
    "linux_node_semantics": "SELECT kind, path, cmd, class FROM node_classes WHERE system = 'linux'",
    "android_node_semantics": "SELECT kind, path, cmd, class FROM node_classes WHERE system = 'android'",
    "residual_score": """
WITH v AS (SELECT label, pos, greatest(var_samp(p - y), 0.000001E0) AS variance FROM vec_pairs GROUP BY label, pos)
SELECT q.vec_id, round(greatest((1 - sum(p * y) / greatest(sqrt(sum(p * p)) * sqrt(sum(y * y)), 0.00000001E0)) * (1 + 0.5E0 / count(*)), 0.0E0), 6) AS legacy,
  round(1 - sum(p * y) / greatest(sqrt(sum(p * p)) * sqrt(sum(y * y)), 0.00000001E0) + 0.25E0 * avg((p - y) * (p - y)), 5) AS raw_mse, round(1 - sum(p * y) / greatest(sqrt(sum(p * p)) * sqrt(sum(y * y)), 0.00000001E0) + 0.25E0 * sum((p - y) * (p - y) / (v.variance + 0.000001E0)), 4) AS var_calibrated
FROM vec_pairs q JOIN v ON v.label = q.label AND v.pos = q.pos GROUP BY q.vec_id""",
    "score_targets": "SELECT vec_id, pos, round((p + 0.5E0 * y + p) / 2.5E0, 6) AS weighted_target, round((p + y) / 2, 6) AS pair_target, round((p + y + p) / 3, 6) AS event_target, round(0.5E0 * (p + y + p) / 3 + 0.25E0 * (p + y), 6) AS mixture_target FROM vec_pairs",
    "top_residual_dims": "SELECT vec_id, r, pos, round(abs(p - y), 6) AS residual FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(p - y) DESC, pos) AS r FROM vec_pairs) x WHERE r <= 3",
    "state_asof": """
SELECT host, stream_pos, node_id, round(coalesce(lag(score) OVER (PARTITION BY host, node_id ORDER BY stream_pos), 0.0E0), 6) AS last_score, lag(ts_us) OVER (PARTITION BY host, node_id ORDER BY stream_pos) AS last_us FROM touch""",
    "attack_plus_benign_reservoir": """
SELECT host, event_id, label FROM labeled WHERE split = 'test' AND label = 2
UNION ALL SELECT host, event_id, label FROM (SELECT host, event_id, label, row_number() OVER (PARTITION BY host ORDER BY md5(concat(CAST(event_id AS STRING), 's')), event_id) AS r FROM labeled WHERE split = 'test' AND label = 0) x WHERE r <= 200""",
    "train_reservoir": "SELECT host, event_id FROM (SELECT host, event_id, row_number() OVER (PARTITION BY host ORDER BY md5(concat(CAST(event_id AS STRING), 't')), event_id) AS r FROM flow WHERE split = 'train') x WHERE r <= 500",
    "score_drift": """
WITH v AS (SELECT action, avg(score) AS m, stddev_pop(score) AS s FROM flow WHERE split = 'validation' GROUP BY action)
SELECT l.host, l.label, count(*) AS n, round(avg((l.score - v.m) / nullif(v.s, 0)), 6) AS mean_drift FROM labeled l JOIN v ON v.action = l.action WHERE l.split = 'test' GROUP BY l.host, l.label""",
    "quantile_knots": """
WITH q AS (SELECT 0.5E0 AS q UNION ALL SELECT 0.75E0 UNION ALL SELECT 0.9E0 UNION ALL SELECT 0.95E0 UNION ALL SELECT 0.99E0 UNION ALL SELECT 0.999E0),
k AS (SELECT r.action, q.q, max(CASE WHEN r.r = ceil(q.q * (r.n - 1)) THEN r.score END) AS knot FROM action_ranked r CROSS JOIN q GROUP BY r.action, q.q), d AS (SELECT *, lag(knot) OVER (PARTITION BY action ORDER BY q) AS prev FROM k)
SELECT action, q, knot, round(-log10(1 - q), 9) AS surprise FROM d WHERE prev IS NULL OR knot > prev""",
    "hash_sketch": """
WITH t AS (SELECT node_id, token, md5(token) AS h FROM node_tokens), b AS (SELECT node_id, substr(h, 1, 1) AS bucket, CAST(sum(CASE WHEN substr(h, 2, 1) < '8' THEN 1 ELSE -1 END) AS BIGINT) AS v FROM t GROUP BY node_id, substr(h, 1, 1)), n AS (SELECT node_id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS norm FROM b GROUP BY node_id)
SELECT b.node_id, b.bucket, round(coalesce(b.v / nullif(n.norm, 0), 0), 9) AS value FROM b JOIN n ON n.node_id = b.node_id""",
}
