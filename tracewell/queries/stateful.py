"""Batch runs of the stateful folds over the whole event table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators import attributes, learning
from tracewell.operators import flow as flow_
from tracewell.operators.conditional import action_table
from tracewell.sources.audit import Audit
from tracewell.sources.staging import stage
from tracewell.streaming.fold import Fold, folded
from tracewell.streaming.folds import EVENT_FOLDS, NODE_FOLDS, P


def bucketed(events: DataFrame) -> DataFrame:
    """Adds the bucket of an event's source, action and kinds."""
    return events.withColumn("bucket", F.crc32(F.concat_ws("|", F.col("info_src").cast("string"), "action", "src_kind", "dst_kind").cast("binary")) % P.sketch_buckets)


class Placed(NamedTuple):
    """An event as the memory of vectors takes it."""

    host: str
    action: str
    src_kind: str
    dst_kind: str
    stream_pos: int
    event_id: int
    z: np.ndarray


def memory(events: DataFrame, nodes: DataFrame, fold: Fold = EVENT_FOLDS["adaptive_memory"]) -> DataFrame:
    """The memory of vectors over z, the mean of the learned vectors of an event's source, action and destination.

    Events carry the numbers of their ends' bags of words; the vectors of a key's bags come before its events, once each.
    """
    words = stage(attributes.summaries(nodes), "words")
    vectors = stage(learning.fit_word2vec(learning.sentences(events.where("split = 'train'"), words)), "word-vectors")
    of, bags = learning.word_bags(learning.used_words(events, words), vectors, "node_id")
    of = stage(of, "bags-of-nodes")
    actions = action_table(learning.mean_vectors(learning.action_words(events), vectors, "action"))
    own = lambda e: of.select(F.col("node_id").alias(f"info_{e}"), F.col("bag").alias(f"{e}_bag"))
    rows = stage(events.join(own("src"), "info_src").join(own("dst"), "info_dst").select(*fold.key, *fold.order, "event_id", "src_bag", "dst_bag"), "events-with-bags")
    rows = rows.where(F.col("action").isin(list(actions)))
    needed = rows.select(*fold.key, F.explode(F.array("src_bag", "dst_bag")).alias("src_bag")).distinct()
    known = needed.join(bags.withColumnRenamed("bag", "src_bag"), "src_bag").withColumn("stream_pos", F.lit(-1).cast("long"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = known.unionByName(rows, allowMissingColumns=True).select(*fold.key, *fold.order, "event_id", "src_bag", "dst_bag", "embedding")
    dealt = both.repartition(parts, *fold.key).sortWithinPartitions(*fold.key, *fold.order)
    names = T.StructType.fromDDL(fold.output).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, states, held = None, {}, {}
        for pdf in batches:
            out = []
            for *key, pos, event, src, dst, vector in pdf.itertuples(index=False, name=None):
                if key != at:
                    at, states, held = key, {}, {}
                if pos < 0:
                    held[int(src)] = np.asarray(vector)
                else:
                    z = (held[int(src)] + actions[key[1]] + held[int(dst)]) / 3
                    out.append(fold.step(states, Placed(*key, pos, int(event), z)))
            yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(run, fold.output)


def _adaptive_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Audit.of(spark, sf_dir)
    return memory(a.placed, a.nodes)


def needed(flow: DataFrame, fold: Fold) -> DataFrame:
    """The flow with stream_pos and what the fold reads beside: no other column is ordered or written."""
    columns = [*flow_.ORDER, *fold.key, *fold.inputs, *(("info_src", "action", "src_kind", "dst_kind") if "bucket" in fold.key else ())]
    placed = flow_.with_stream_pos(flow.select(*(c for c in dict.fromkeys(columns) if c != "bucket")))
    return bucketed(placed) if "bucket" in fold.key else placed


def _over_flow(fold: Fold) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: folded(needed(Audit.of(spark, sf_dir).flow, fold), fold)


def _over_touch(fold: Fold) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: folded(Audit.of(spark, sf_dir).touch_placed, fold)


def role_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, stream_pos and the length of the states that an event's ends start from; new nodes start from their kind's prototype."""
    return QUERIES["lru_eviction"](spark, sf_dir).select("host", "stream_pos", "src_start", "dst_start")


QUERIES = {n: _over_flow(f) for n, f in EVENT_FOLDS.items()} | {n: _over_touch(f) for n, f in NODE_FOLDS.items()}
QUERIES |= {"role_prototypes": role_prototypes, "adaptive_memory": _adaptive_memory}
