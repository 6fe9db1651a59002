"""Scans, projections, joins and set operations over audit tables (see operators.flow for their columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators.flow import with_ends
from tracewell.operators.prefix import numbered, share_above

# Relations and families of actions, ids of kinds.
RELATIONS = {"EVENT_READ": "read", "EVENT_RECVFROM": "recv", "EVENT_RECVMSG": "recv", "EVENT_WRITE": "write", "EVENT_SENDTO": "send", "EVENT_SENDMSG": "send", "EVENT_CONNECT": "send", "EVENT_EXECUTE": "spawn", "EVENT_CLONE": "spawn", "EVENT_OPEN": "open"}
FAMILIES = RELATIONS | {"EVENT_OPEN": "read", "EVENT_FORK": "spawn"}
KIND_IDS = {"process": 0, "file": 1, "netflow": 2}
ATTACK_NAMES = {"2": "malicious", "malicious": "malicious", "attack": "malicious", "1": "suspicious", "suspicious": "suspicious", "true": "suspicious"}


def mapped(column: str | Column, values: dict, other) -> Column:
    """A fixed mapping of a column's values, ``other`` for the rest."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def squeezed(path: Column) -> Column:
    """A path with runs of slashes as one."""
    return F.regexp_replace(path, "/+", "/")


def node_lookup(nodes: DataFrame) -> DataFrame:
    """One row for each node_id: of clashing rows a file's wins over a process's, and that over a netflow's."""
    priority = mapped("kind", {"netflow": 0, "process": 1}, 2)
    summary = F.when(F.col("kind") == "netflow", F.concat_ws(":", "dst_addr", "dst_port")).when(F.col("kind") == "process", F.concat_ws(" ", "path", "cmd")).otherwise(F.col("path"))
    best = nodes.select("node_id", "uuid", priority.alias("p"), F.struct("kind", summary.alias("summary")).alias("row"))
    return best.groupBy("node_id").agg(F.max("uuid").alias("uuid"), F.max_by("row", "p").alias("row")).select("node_id", "uuid", "row.*")


def in_ranges(events: DataFrame, ranges: list[tuple[str, str]]) -> DataFrame:
    """Events in any of the half-open ranges of time; none for an empty list. The filter reaches the scan."""
    keep = F.lit(False)
    for lo, hi in ranges:
        keep = keep | ((F.col("ts") >= F.lit(lo).cast("timestamp")) & (F.col("ts") < F.lit(hi).cast("timestamp")))
    return events.where(keep)


def first_events(events: DataFrame, n: int) -> DataFrame:
    """The first n events in the order of the stream; all for 0."""
    return events.orderBy("ts_us", "event_id").limit(n) if n else events


def split_counts(events: DataFrame, actions: tuple[str, ...], by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n_events"), F.count_if(F.col("action").isin(*actions)).alias("n_scored"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def action_filter_report(events: DataFrame, actions: tuple[str, ...], by: list[str]) -> DataFrame:
    """by, rows and distinct actions before and after keeping only ``actions``."""
    kept = F.col("action").isin(*actions)
    return events.groupBy(*by).agg(F.count("*").alias("n_before"), F.count_if(kept).alias("n_after"), F.count_distinct("action").alias("actions_before"), F.count_distinct(F.when(kept, F.col("action"))).alias("actions_after"))


def compact_index(flow: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    ids = {a: i for i, a in enumerate(actions)}
    return flow.select("host", "split", "stream_pos", "event_id", "info_src", "info_dst", mapped("action", ids, None).alias("action_id"), mapped("src_kind", KIND_IDS, 3).alias("src_type"), mapped("dst_kind", KIND_IDS, 3).alias("dst_type"))


def structured_export(labelled: DataFrame) -> DataFrame:
    return labelled.select("split", "event_id", (F.col("ts_us") * 1000).alias("timestamp_ns"), F.col("actor_id").alias("process_idx"), "action", F.col("object_kind").alias("object_type"), F.col("info_src").alias("src_idx"), F.col("info_dst").alias("dst_idx"), "label")


def resolution_report(events: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """by, events, those with both ends in ``nodes``, and the others."""
    both = F.col("s.node_id").isNotNull() & F.col("d.node_id").isNotNull()
    return with_ends(events, nodes, "left").groupBy(*by).agg(F.count("*").alias("n_events"), F.count_if(both).alias("n_resolved"), F.count_if(~both).alias("n_skipped"))


def messages(nodes: DataFrame) -> DataFrame:
    """What a node says of itself: address, command line or path."""
    net = F.col("kind") == "netflow"
    said = F.when(net, F.col("dst_addr")).when(F.col("kind") == "process", F.nullif(F.concat_ws(" ", "path", "cmd"), F.lit(""))).otherwise(squeezed(F.col("path")))
    return nodes.select("node_id", "kind", said.alias("message"), F.when(net, F.concat_ws(":", "dst_addr", "dst_port")).alias("message_with_port"))


def event_texts(flow: DataFrame, nodes: DataFrame) -> DataFrame:
    thing = F.when(F.col("kind") == "netflow", F.concat_ws(":", "dst_addr", "dst_port")).otherwise(squeezed(F.col("path")))
    actors, objects = nodes.select(F.col("node_id").alias("actor_id"), F.col("path").alias("__actor")), nodes.select(F.col("node_id").alias("object_id"), thing.alias("__object"))
    text = F.concat_ws(" ", F.lit("A_PROCESS"), "__actor", "action", F.concat(F.lit("O_"), F.upper("object_kind")), "__object")
    return flow.join(actors, "actor_id").join(objects, "object_id").select("host", "event_id", text.alias("text"))


def node_words(nodes: DataFrame) -> DataFrame:
    path = F.replace(F.col("path"), F.lit("/"), F.lit(" "))
    tokens = F.when(F.col("kind") == "netflow", F.concat(F.lit("ip_"), F.replace(F.col("dst_addr"), F.lit("."), F.lit("_")))).when(F.col("kind") == "process", F.coalesce(path, F.lit("unknown"))).otherwise(path)
    return nodes.select("node_id", "kind", tokens.alias("tokens"))


def with_words(flow: DataFrame, words: DataFrame) -> DataFrame:
    """Adds src_tokens and dst_tokens."""
    s, d = (words.select(F.col("node_id").alias(f"info_{e}"), F.col("tokens").alias(f"{e}_tokens")) for e in ("src", "dst"))
    return flow.join(s, "info_src").join(d, "info_dst")


def label_names(labels: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds name and is_attack for the spellings of a label."""
    plain = F.lower(F.trim(raw))
    return labels.withColumn("name", mapped(plain, ATTACK_NAMES, "benign")).withColumn("is_attack", plain.isin(*ATTACK_NAMES).cast("int"))


def alert_features(alerts: DataFrame, nodes: DataFrame) -> DataFrame:
    s, d = (nodes.select(F.col("node_id").alias(f"info_{e}"), F.col("path").alias(f"__{e}")) for e in ("src", "dst"))
    has = lambda part: F.coalesce(F.col("__src").contains(part) | F.col("__dst").contains(part), F.lit(False))
    rows = alerts.join(s, "info_src").join(d, "info_dst")
    return rows.select("host", "event_id", F.concat("src_kind", F.lit("->"), "dst_kind").alias("type_pair"), (F.col("score") - F.col("thr")).alias("margin"), has("/tmp").alias("has_tmp"), has(".so").alias("has_so"), F.concat_ws("|", "action", "src_kind", "dst_kind").alias("alert_group"))


def enriched(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events with a process at one end and both ends' attributes."""
    rows = with_ends(events, nodes).where("s.kind = 'process' OR d.kind = 'process'")
    return rows.select("host", "event_id", "action", F.col("s.kind").alias("src_kind"), F.col("s.path").alias("src_path"), F.col("s.cmd").alias("src_cmd"), F.col("d.kind").alias("dst_kind"), F.col("d.path").alias("dst_path"), "d.dst_addr", "d.dst_port")


def endpoints(flow: DataFrame, *ends: str) -> DataFrame:
    """Distinct node_id of the named columns."""
    return flow.select(F.explode(F.array(*(ends or ("info_src", "info_dst")))).alias("node_id")).distinct()


def resolved_truth(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """uuid, node_id: the node with that uuid, else the index stored in the file if it is a number."""
    known = nodes.select("uuid", "node_id")
    return files.join(known, "uuid", "left").select("uuid", F.coalesce("node_id", F.try_to_number("old_index", F.lit("9" * 18)).cast("long")).alias("node_id"))


def missing_nodes(events: DataFrame, nodes: DataFrame) -> DataFrame:
    return endpoints(events, "src_id", "dst_id").join(nodes, "node_id", "left_anti")


def alert_labels(alerts: DataFrame, labelled: DataFrame) -> DataFrame:
    """Alerts with the label of their event, 0 if it has none."""
    return alerts.select("host", "event_id").join(labelled.select("host", "event_id", "label"), ["host", "event_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def node_labels(touched: DataFrame, truth: DataFrame) -> DataFrame:
    bad = truth.select("node_id").distinct().withColumn("malicious", F.lit(1))
    return touched.select("node_id").distinct().join(bad, "node_id", "left").withColumn("malicious", F.coalesce("malicious", F.lit(0)))


def in_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events in each attack window (inclusive); windows are a list kept by hand."""
    return events.join(F.broadcast(windows), F.col("ts").between(F.col("start_ts"), F.col("end_ts")))


def aligned(predictions: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """by, predictions, how many of them have an event, and whether all do."""
    there = events.select("host", "event_id", F.lit(1).alias("__there"))
    rows = predictions.join(there, ["host", "event_id"], "left")
    return rows.groupBy(*by).agg(F.count("*").alias("n_predictions"), F.count("__there").alias("n_aligned"), (F.count("*") == F.count("__there")).alias("aligned"))


def compact_ids(touched: DataFrame, by: list[str]) -> DataFrame:
    """by, node_id, compact_id: the place among the distinct ids, from 0."""
    return numbered(touched.select(*by, "node_id").distinct(), by, [F.col("node_id")], "compact_id", 0)


def remapped(flow: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    s, d = (ids.select(*by, F.col("node_id").alias(f"info_{e}"), F.col("compact_id").alias(f"{e}_compact")) for e in ("src", "dst"))
    return flow.join(s, [*by, "info_src"]).join(d, [*by, "info_dst"])


def tail(scored: DataFrame, by: list[str], reference: str, wanted: str) -> DataFrame:
    """Wanted rows with p_value, (reference rows with at least this score + 1) / (reference rows + 1), and surprisal, -ln of it."""
    x = scored.where(f"({reference}) OR ({wanted})")
    found = share_above(x, by, "score", F.expr(reference)).where(wanted)
    return found.withColumn("p_value", (F.col("n_above") + 1.0) / (F.col("n_reference") + 1.0)).withColumn("surprisal", -F.log("p_value"))


def split_algebra(touched: DataFrame, a: str = "train", b: str = "test") -> DataFrame:
    """part, node_id: nodes of both splits, and those that only the second has."""
    seen = touched.groupBy("node_id").agg(F.max((F.col("split") == a).cast("int")).alias("a"), F.max((F.col("split") == b).cast("int")).alias("b"), F.max((F.col("split") != b).cast("int")).alias("other"))
    part = F.when(F.expr("a = 1 AND b = 1"), f"{a}_and_{b}").when(F.expr("b = 1 AND other = 0"), f"{b}_only")
    return seen.select(part.alias("part"), "node_id").where("part IS NOT NULL")


def held_out_owners(flow: DataFrame, by: list[str], ratio: float, salt: str) -> DataFrame:
    """Rows with part: ``val`` for the events of ceil(ratio x owners) actors, the first by a hash, at least one and not all; else ``train``."""
    owners = flow.select(*by, "actor_id").distinct().withColumn("h", F.md5(F.concat(F.col("actor_id").cast("string"), F.lit(salt)).cast("binary")))
    placed = numbered(owners, by, [F.col("h"), F.col("actor_id")], "r")
    n = owners.groupBy(*by).agg(F.count("*").alias("n"))
    val = (F.col("n") >= 2) & (F.col("r") <= F.greatest(F.lit(1), F.least(F.col("n") - 1, F.ceil(F.lit(ratio) * F.col("n")))))
    return flow.join(placed.join(n, by).select(*by, "actor_id", F.when(val, "val").otherwise("train").alias("part")), [*by, "actor_id"])


def first_by_group(flow: DataFrame, by: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each group; a partial first n is taken before the shuffle."""
    return flow.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n)


def reservoir(rows: DataFrame, by: list[str], n: int, salt: str) -> DataFrame:
    """n rows of each group, the first by a salted hash of event_id: the same ones at every run."""
    h = F.md5(F.concat(F.col("event_id").cast("string"), F.lit(salt)).cast("binary"))
    return first_by_group(rows, by, n, [h, F.col("event_id")]).drop("r")
