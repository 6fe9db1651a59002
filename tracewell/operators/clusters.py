"""Node states that are nearly alike share one: states in closed form, clusters within buckets of signs, and what they save."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators.flow import order
from tracewell.operators.vectors import dot
from tracewell.streaming.folds import D, TAUS, message

_KEEPS = sorted({float(t) for t in TAUS})
STATE_BYTES = 4 * D


def final_states(touched: DataFrame) -> DataFrame:
    """host, node_id, kind, n, state: the decayed sum that the fold of a node's events ends with, without a fold.

    An event's vector depends on its action and kinds alone, and its weight on how many events of the node follow. So the
    weights are added up by (node, action, kinds) for each time constant, natively, and only these sums meet the vectors.
    """
    later = F.count("*").over(Window.partitionBy("host", "node_id").orderBy(*(c.desc() for c in order()))) - 1
    keys = ["host", "node_id", "action", "kind", "peer_kind"]
    weights = [F.sum(F.exp(-F.col("later") / t) * (1 - float(np.exp(-1 / t)))).alias(f"w{i}") for i, t in enumerate(_KEEPS)]
    summed = touched.withColumn("later", later).groupBy(*keys).agg(F.count("*").alias("c"), *weights)
    parts = F.struct("action", "kind", "peer_kind", "c", F.array(*(f"w{i}" for i in range(len(_KEEPS)))).alias("w"))
    nodes = summed.groupBy("host", "node_id").agg(F.max("kind").alias("kind"), F.sum("c").alias("n"), F.collect_list(parts).alias("parts"))  # at most actions x kinds x kinds parts
    column = np.array([_KEEPS.index(float(t)) for t in TAUS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            states = [sum((np.array(p["w"])[column] * message(p["action"], p["kind"], p["peer_kind"]) for p in parts), np.zeros(D)).tolist() for parts in pdf["parts"]]
            yield pdf[["host", "node_id", "kind", "n"]].assign(state=states)

    return nodes.mapInPandas(run, "host string, node_id long, kind string, n long, state array<double>")


def merged_states(states: DataFrame, least: float = 0.98, bits: int = 12, seed: int = 7) -> DataFrame:
    """Adds cluster: nodes of one host and kind whose states have a cosine of ``least`` or more with a leader's share it.

    Candidates agree in the signs of ``bits`` random projections; the leader of a bucket is its node with the most events, then the
    smallest id. Who isn't near enough to it keeps a state of its own. Nothing is compared within a bucket but with the leader.
    """
    planes = np.random.default_rng(seed).normal(size=(bits, D))
    sign = [F.when(dot("state", F.array(*map(F.lit, map(float, p)))) > 0, 1 << i).otherwise(0) for i, p in enumerate(planes)]
    bucketed = states.withColumn("bucket", sum(sign[1:], sign[0]))
    keys = ["host", "kind", "bucket"]
    leaders = bucketed.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("node_id")).alias("minus"), F.col("state").alias("lead"))).alias("l")).select(*keys, (-F.col("l.minus")).alias("leader"), "l.lead")
    near = dot("state", "lead") / F.greatest(F.sqrt(dot("state", "state")) * F.sqrt(dot("lead", "lead")), F.lit(1e-8)) >= least
    return bucketed.join(leaders, keys).withColumn("cluster", F.when(near, F.col("leader")).otherwise(F.col("node_id"))).select("host", "node_id", "kind", "n", "state", "cluster")


def last_places(shared: DataFrame) -> DataFrame:
    """host, node_id, kind, n, cluster: the place of each node's state after its last event, from the rows of ``streaming.merging``; it only changes with the node."""
    end = lambda e, own: F.struct(F.col(f"info_{e}").alias("node_id"), F.col(f"{e}_kind").alias("kind"), F.col(f"{e}_place").alias("place"), F.lit(own).alias("own"))
    loop = F.col("info_src") == F.col("info_dst")
    ends = F.filter(F.array(end("src", 1), F.when(~loop, end("dst", 0))), lambda x: x.isNotNull())
    rows = shared.select("host", "stream_pos", F.explode(ends).alias("e")).select("host", "stream_pos", "e.*")
    return rows.groupBy("host", "node_id").agg(F.max("kind").alias("kind"), F.count("*").alias("n"), F.max_by("place", "stream_pos").alias("cluster"))


def alert_places(alerts: DataFrame, shared: DataFrame) -> DataFrame:
    """Alerts with their ends' places when they came, and whether both ends held one state."""
    own = shared.select("host", "event_id", F.col("src_place").alias("src_cluster"), F.col("dst_place").alias("dst_cluster"))
    return alerts.join(own, ["host", "event_id"]).withColumn("same_cluster", F.col("src_cluster") == F.col("dst_cluster"))


def compression(merged: DataFrame) -> DataFrame:
    """host, logical and physical states, clusters of several, their ratio and the bytes saved."""
    sizes = merged.groupBy("host", "cluster").agg(F.count("*").alias("members"))
    return sizes.groupBy("host").agg(F.sum("members").alias("logical_states"), F.count("*").alias("physical_states"), F.count_if(F.col("members") > 1).alias("clusters"), (F.count("*") / F.sum("members")).alias("ratio"), ((F.sum("members") - F.count("*")) * STATE_BYTES).alias("bytes_saved"))
