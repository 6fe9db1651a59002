"""Node scores and re-ranking after the stream: what a node's touches add up to, and rules for bands of ranks.

Touches are a row for each event and node (operators.flow.touches) with score and thr. Weights and bands are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.prefix import numbered
from tracewell.operators.relational import mapped
from tracewell.sources.mapping import ACTIONS
from tracewell.sources.staging import stage


@dataclass(frozen=True)
class Weights:
    high: float = 2.0
    soft: float = 0.5
    chain: float = 0.0
    #: soft evidence counts from this share of the threshold on
    soft_from: float = 0.5


def evidence(touched: DataFrame, w: Weights = Weights(), actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """host, node_id and what its touches add up to: best score, touches over threshold, soft evidence, roles, diversity, stability.

    Actions are bits, at most 63 and none but ``actions``, so that peers alone are counted as distinct and a touch is one row of the grouping, not three.
    """
    action_bit = F.when(F.col("action").isNotNull(), mapped("action", {a: 1 << i for i, a in enumerate(actions)}, F.raise_error(F.concat(F.lit("not among the actions: "), "action")).cast("long")).cast("long"))
    peer_bit = mapped("peer_kind", {"process": 1, "file": 2}, 4)
    return touched.groupBy("host", "node_id").agg(
        F.max("kind").alias("kind"), F.max("score").alias("max_score"), F.count_if(F.expr("score >= thr")).alias("n_high"), F.sum(F.greatest(F.col("score") - F.col("thr") * w.soft_from, F.lit(0.0))).alias("soft"),
        F.count("*").alias("n"), F.sum("as_src").alias("n_src"), F.sum("as_dst").alias("n_dst"), F.count_distinct("peer").alias("peers"), F.coalesce(F.bit_count(F.bit_or(action_bit)).cast("long"), F.lit(0)).alias("actions"),
        F.bit_or(peer_bit).alias("peer_mask"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
    )


def scores(nodes: DataFrame, w: Weights = Weights(), chain: Column | None = None) -> DataFrame:
    """Adds node_score: the best score and weighted logarithms of hits and soft evidence, and a chain signal (0 to 1) if there is one."""
    base = F.col("max_score") + w.high * F.log1p("n_high") + w.soft * F.log1p("soft")
    return nodes.withColumn("node_score", base if chain is None else base + w.chain * chain)


def chain_signal(nodes: DataFrame) -> Column:
    """Distinct actions for each touch, up to 1: how much of a node's activity is new."""
    return F.least(F.lit(1.0), F.col("actions") / F.col("n"))


def features(nodes: DataFrame) -> DataFrame:
    """Adds peer_kinds, stability (1 where all scores are alike) and chain."""
    return nodes.withColumns({"peer_kinds": F.bit_count("peer_mask"), "stability": 1 / (1 + F.col("std_score") / F.greatest(F.abs("mean_score"), F.lit(1e-9))), "chain": chain_signal(nodes)})


def ranked(nodes: DataFrame) -> DataFrame:
    """Adds rk by best score, and the host's median and 0.9 quantile of touches and its most soft evidence. The nodes are written once."""
    nodes = stage(nodes, "nodes")
    stats = nodes.groupBy("host").agg(F.percentile(F.col("n").cast("double"), 0.5).alias("med_n"), F.percentile(F.col("n").cast("double"), 0.9).alias("q90_n"), F.max("soft").alias("max_soft"))
    return numbered(nodes, ["host"], [F.col("max_score").desc(), F.col("node_id")], "rk", written=True).join(stats, "host")


def _log_excess(a: str, b: str) -> Column:
    return F.greatest(F.log1p(a) - F.log1p(b), F.lit(0.0))


def reranked(nodes: DataFrame, scale: float = 1000.0, high: float = 2.0, passive: float = 1.0, activity: float = 1.0) -> DataFrame:
    """Adds reranked: weighted support, less a penalty for nodes that are only ever destinations and for activity beyond the host's 0.9 quantile."""
    support = F.col("max_score") / scale + high * F.log1p("n_high") + F.col("soft") / F.nullif(F.col("max_soft"), F.lit(0.0))
    return nodes.withColumn("reranked", support - F.when(F.col("n_src") == 0, passive).otherwise(0.0) - activity * _log_excess("n", "q90_n"))


def in_band(band: tuple[int, int]) -> Column:
    return F.col("rk").between(*band)


def chain_boost(nodes: DataFrame, band: tuple[int, int] = (21, 200), rate: float = 0.1, most: float = 3.0, usual: float = 10.0) -> DataFrame:
    """Adds boosted: in the band, scores rise with the density of distinct actions over the usual one."""
    z = F.least(F.lit(most), F.greatest((F.col("actions") / F.col("n")) / (usual / F.col("med_n")) - 1, F.lit(0.0)))
    return nodes.withColumn("boosted", F.when(in_band(band), F.col("max_score") * (1 + rate * z)).otherwise(F.col("max_score")))


def closure(nodes: DataFrame, band: tuple[int, int] = (21, 300), kinds: float = 100.0, both: float = 50.0) -> DataFrame:
    """Adds closure: in the band, a bonus for each further kind of peer, and for being source and destination (a penalty otherwise)."""
    bonus = kinds * (F.bit_count("peer_mask") - 1) + F.when((F.col("n_src") > 0) & (F.col("n_dst") > 0), both).otherwise(-both)
    return nodes.withColumn("closure", F.col("max_score") + F.when(in_band(band), bonus).otherwise(0.0))


def evidence_gate(nodes: DataFrame, band: tuple[int, int] = (51, 500), step: float = 0.05) -> DataFrame:
    """Adds families, of four kinds of evidence how many there are, and gated: in the band three raise the score, fewer than two lower it."""
    families = (F.col("n_high") > 0).cast("int") + (F.col("peers") >= 3).cast("int") + (F.col("actions") >= 3).cast("int") + (F.bit_count("peer_mask") >= 2).cast("int")
    gate = F.when(F.col("families") >= 3, 1 + step).when(F.col("families") == 2, 1.0).otherwise(1 - step)
    return nodes.withColumn("families", families).withColumn("gated", F.col("max_score") * F.when(in_band(band), gate).otherwise(1.0))


def mid_rank_gate(nodes: DataFrame, band: tuple[int, int] = (101, 1000), factor: float = 0.9) -> DataFrame:
    """Adds gated: in the band, nodes without a hit and with fewer than two peers lose a share of their score."""
    bare = in_band(band) & (F.col("n_high") == 0) & (F.col("peers") < 2)
    return nodes.withColumn("gated", F.when(bare, F.col("max_score") * factor).otherwise(F.col("max_score")))


def local_closure(nodes: DataFrame, band: tuple[int, int] = (11, 500)) -> DataFrame:
    """Adds core, the least of three logarithms of support, and passes: within the band with two peers, two actions and a hit."""
    core = F.least(F.log1p("peers"), F.log1p("actions"), F.log1p("n_high"))
    return nodes.withColumn("core", core).withColumn("passes", in_band(band) & F.expr("peers >= 2 AND actions >= 2 AND n_high >= 1"))
