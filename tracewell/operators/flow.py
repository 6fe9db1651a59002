"""From raw events and nodes to directed information flow, and what each node has seen before each event.

Tables. nodes: node_id, uuid, kind (process, file, netflow), path, cmd, dst_addr, dst_port. events: host, event_id, ts, ts_us,
src_id, dst_id, action, split, score. Order within a host is (ts_us, event_id). Null ids join nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators.prefix import numbered

# Actions whose information comes from the object, and those that end in the actor.
FROM_OBJECT = ("EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG")
TO_ACTOR = (*FROM_OBJECT, "EVENT_OPEN")
#: order of events within a host
ORDER = ("ts_us", "event_id")


def order() -> list[Column]:
    return [F.col(c) for c in ORDER]


def with_ends(events: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """Events with structs ``s`` and ``d`` of their source's and destination's node rows."""
    rows = nodes.select("node_id", F.struct(*(c for c in nodes.columns)).alias("row"))
    s, d = (rows.select(F.col("node_id").alias(f"__{n}"), F.col("row").alias(n)) for n in "sd")
    return events.join(s, F.col("src_id") == F.col("__s"), how).join(d, F.col("dst_id") == F.col("__d"), how).drop("__s", "__d")


def actor_object(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events with a process at one end: actor_id, object_id, object_kind, object_addr, swapped; other events are dropped."""
    own = F.col("s.kind") == "process"
    ended = with_ends(events, nodes).where(own | (F.col("d.kind") == "process"))
    pick = lambda a, b, out: F.when(own, F.col(a)).otherwise(F.col(b)).alias(out)
    return ended.select(*events.columns, pick("src_id", "dst_id", "actor_id"), pick("dst_id", "src_id", "object_id"), pick("d.kind", "s.kind", "object_kind"), pick("d.dst_addr", "s.dst_addr", "object_addr"), (~own).alias("swapped"))


def information_flow(events: DataFrame, nodes: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """The scored events as directed flow: info_src, info_dst, src_kind, dst_kind beside actor and object."""
    act = actor_object(events.where(F.col("action").isin(*actions)), nodes)
    incoming, to_actor = F.col("action").isin(*FROM_OBJECT), F.col("action").isin(*TO_ACTOR)
    return act.drop("src_id", "dst_id", "swapped", "object_addr").withColumns({
        "info_src": F.when(incoming, F.col("object_id")).otherwise(F.col("actor_id")), "info_dst": F.when(to_actor, F.col("actor_id")).otherwise(F.col("object_id")),
        "src_kind": F.when(incoming, F.col("object_kind")).otherwise("process"), "dst_kind": F.when(to_actor, F.lit("process")).otherwise(F.col("object_kind")),
    })


def with_stream_pos(flow: DataFrame) -> DataFrame:
    """Adds each event's place in its host's stream, from 0; no host is ordered in one task."""
    return numbered(flow, ["host"], order(), "stream_pos", 0)


def labelled(flow: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: the number of an event's ends (actor, object) that are in ``truth`` (node_id). Only for use after scoring."""
    bad = truth.select("node_id").distinct()
    a, o = bad.select(F.col("node_id").alias("__a")), bad.select(F.col("node_id").alias("__o"))
    both = flow.join(a, F.col("actor_id") == F.col("__a"), "left").join(o, F.col("object_id") == F.col("__o"), "left")
    return both.withColumn("label", F.col("__a").isNotNull().cast("int") + F.col("__o").isNotNull().cast("int")).drop("__a", "__o")


def touches(flow: DataFrame) -> DataFrame:
    """A row for each event and node it touches: node_id, kind, peer, peer_kind, as_src, as_dst; a self-loop is one touch in both roles."""
    loop = F.col("info_src") == F.col("info_dst")
    end = lambda a, b, src: F.struct(F.col(f"info_{a}").alias("node_id"), F.col(f"{a}_kind").alias("kind"), F.col(f"info_{b}").alias("peer"), F.col(f"{b}_kind").alias("peer_kind"), F.lit(src).alias("as_src"), (loop.cast("int") if src else F.lit(1)).alias("as_dst"))
    ends = F.filter(F.array(end("src", "dst", 1), F.when(~loop, end("dst", "src", 0))), lambda x: x.isNotNull())
    return flow.withColumn("end", F.explode(ends)).select(*(c for c in flow.columns if c not in ("info_src", "info_dst", "src_kind", "dst_kind")), "end.*")


def counts_before(touched: DataFrame) -> DataFrame:
    """Adds n_before, src_before, dst_before: the node's touches in its host before this one."""
    before = Window.partitionBy("host", "node_id").orderBy(*order()).rowsBetween(Window.unboundedPreceding, -1)
    return touched.withColumns({"n_before": F.count("*").over(before), "src_before": F.coalesce(F.sum("as_src").over(before), F.lit(0)), "dst_before": F.coalesce(F.sum("as_dst").over(before), F.lit(0))})


def active(touched: DataFrame) -> DataFrame:
    """Adds is_active: a process from its second touch on, other nodes from their third, or their second if they were a source before."""
    return counts_before(touched).withColumn("is_active", F.when(F.col("kind") == "process", F.col("n_before") >= 1).otherwise((F.col("n_before") >= 2) | (F.col("src_before") >= 1)))


def target_cases(flow: DataFrame) -> DataFrame:
    """Adds src_active, dst_active and target_case; the two ends' flags meet again by event, in one grouping."""
    flags = active(touches(flow)).groupBy("host", "event_id").agg(
        F.max(F.when(F.col("as_src") == 1, F.col("is_active"))).alias("src_active"), F.max(F.when(F.col("as_dst") == 1, F.col("is_active"))).alias("dst_active")
    )
    case = F.when(F.col("src_active") | F.col("dst_active"), "event_semantic").otherwise("both_cold_action")
    return flow.join(flags, ["host", "event_id"]).withColumn("target_case", case)


def histories(flow: DataFrame, nodes: DataFrame) -> DataFrame:
    """Writes and sends of processes to the network, with src and endpoint (address and port, else the node)."""
    out = flow.where("action IN ('EVENT_WRITE', 'EVENT_SENDTO') AND src_kind = 'process' AND dst_kind = 'netflow'")
    named = nodes.select(F.col("node_id").alias("info_dst"), endpoint_signature(nodes.columns).alias("endpoint"))
    return out.join(named, "info_dst").withColumn("src", F.col("info_src"))


def endpoint_signature(columns: Sequence[str] = ("dst_addr", "dst_port")) -> Column:
    """Address and port of a node, else those of its source where ``columns`` has src_addr, else its id; blank addresses are none."""
    found = F.lit(None).cast("string")
    for end in ("src", "dst"):
        if f"{end}_addr" in columns:
            port = F.coalesce(F.trim(f"{end}_port"), F.lit("")) if f"{end}_port" in columns else F.lit("")
            found = F.when(F.trim(f"{end}_addr") != "", F.concat(F.trim(f"{end}_addr"), F.lit(":"), port)).otherwise(found)
    return F.coalesce(found, F.concat(F.lit("node:"), F.col("node_id").cast("string")))
