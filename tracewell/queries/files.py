"""Registered queries of sources and sinks: what they write to the shared folder is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import evaluation
from tracewell.operators import relational as rel
from tracewell.sources import files
from tracewell.sources.audit import Audit
from tracewell.sources.staging import shared_dir, stage
from tracewell.streaming import sinks

THRESHOLD = 50.0
#: thresholds by group are fitted on the events before
FITTED = "2024-01-11 00:00:00"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ground_truth_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth written as a file with commas and one with tabs, each with a header and a blank line, and read again."""
    a, at = Audit.of(spark, sf_dir), _folder(spark, "truth")
    for i, sep in enumerate((",", "\t")):
        lines = a.truth.where(F.col("node_id") % 2 == i).select(F.concat_ws(sep, "uuid", F.lit("noted"), F.col("node_id").cast("string")).alias("value"))
        head = spark.createDataFrame([(sep.join(("uuid", "info", "old_index")),), ("",), (sep.join(("", "no id", "7")),)], "value string")
        head.unionByName(lines).unionByName(lines).write.text(f"{at}/{i}")
    return rel.resolved_truth(files.read_truth(spark, [f"{at}/0", f"{at}/1"]), a.nodes)


def structured_event_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their text and label, written by split and read back."""
    a, at = Audit.of(spark, sf_dir), _folder(spark, "structured")
    texts = rel.event_texts(a.labelled, a.nodes).withColumnRenamed("event_id", "__event").select("__event", "text")
    rows = rel.structured_export(a.labelled).join(texts, F.col("event_id") == F.col("__event")).drop("__event")
    rows.write.partitionBy("split").parquet(at)
    return spark.read.parquet(at)


def compact_event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric index, written with a sidecar that holds its fingerprint, and read back against it."""
    a, at = Audit.of(spark, sf_dir), _folder(spark, "index")
    rel.compact_index(a.placed, a.actions).write.parquet(f"{at}/index")
    index = spark.read.parquet(f"{at}/index")
    spark.createDataFrame([(sinks.fingerprint(index),)], "fingerprint string").coalesce(1).write.json(f"{at}/sidecar")
    if spark.read.schema("fingerprint string").json(f"{at}/sidecar").first()["fingerprint"] != sinks.fingerprint(index):
        raise ValueError("the index isn't what its sidecar says")
    return index


def incremental_day_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, n: days exported in two runs, of which the second skips what the first wrote."""
    events, at = Audit.of(spark, sf_dir).events.select("host", "event_id", "ts"), _folder(spark, "days")
    sinks.export_days(events.where("ts < TIMESTAMP '1999-01-01 00:00:00'"), at)
    sinks.export_days(events, at)
    return spark.read.parquet(at).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The events table as a stream: a file source reads folders, so the table is written as one."""
    at = _folder(spark, "stream")
    spark.read.parquet(f"{sf_dir}/events.parquet").select(*(F.col(f.name).cast(f.dataType) for f in sinks.EVENT_SCHEMA.fields)).write.parquet(f"{at}/in")
    return sinks.mapped(sinks.event_stream(spark, f"{at}/in", late="36500 days", files=4)), at


def event_stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, at = _stream(spark, sf_dir)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select("host", "event_id", "src_id", "dst_id", "action", "score")


def _sunk(spark: SparkSession, sf_dir: str) -> str:
    stream, at = _stream(spark, sf_dir)
    sinks.alert_sink(stream, f"{at}/alerts", f"{at}/checkpoint", THRESHOLD, f"{at}/trace").awaitTermination()
    return at


def alert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts that a stream left, and which of them have an end that is bad: labels come after the stream has ended."""
    at = _sunk(spark, sf_dir)
    bad = Audit.of(spark, sf_dir).truth
    return sinks.evaluated(spark.read.parquet(f"{at}/alerts"), bad).select("host", "event_id", "score", "label")


def score_trace_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of a stream against one threshold for all."""
    return spark.read.parquet(f"{_sunk(spark, sf_dir)}/trace").select("host", "event_id", "score", "threshold", "threshold_level", "score_group")


def score_trace_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of a stream against the thresholds of its groups, fitted on the events before FITTED."""
    stream, at = _stream(spark, sf_dir)
    past = sinks.mapped(spark.read.parquet(f"{at}/in").where(f"ts < TIMESTAMP '{FITTED}'"))
    sinks.alert_sink(stream, f"{at}/alerts", f"{at}/checkpoint", stage(sinks.fit_levels(past), "levels"), f"{at}/trace").awaitTermination()
    return spark.read.parquet(f"{at}/trace").select("host", "event_id", "score", "threshold", "threshold_level", "score_group")


def calibration_artifact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds written with the fingerprint of the scores they were fitted on, and loaded for the same scores."""
    a, at = Audit.of(spark, sf_dir), _folder(spark, "artefact")
    source = a.validation.select("action", "score")
    sinks.save_artefact(a.thresholds, source, at)
    return sinks.load_artefact(spark, source, at)


def leakage_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, n_rows, leaks: the tables that scoring reads and the labelled ones, with the forbidden fields of their schemas."""
    a = Audit.of(spark, sf_dir)
    tables = {"events": a.events, "flow": a.flow, "touch": a.touch, "thresholds": a.thresholds, "labelled": a.labelled, "alerts": a.alerts}
    return reduce(DataFrame.unionByName, (t.agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows"), F.lit(",".join(sinks.leaks(t.schema))).alias("leaks")) for n, t in tables.items()))


def cross_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's event confusion written as the metrics file of a run, and all of them read as one table."""
    a, at = Audit.of(spark, sf_dir), _folder(spark, "runs")
    counts = evaluation.event_confusion(a.judged, ["host"])
    values = F.create_map(*(x for c in ("tp", "fp", "fn", "tn") for x in (F.lit(c), F.col(c).cast("double"))))
    runs = counts.groupBy(F.col("host").alias("run")).agg(F.map_from_entries(F.collect_list(F.struct("mode", values.alias("v")))).alias("metrics"))
    runs.write.json(at)
    return files.cross_run_summary(spark, [at])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (ground_truth_nodes, structured_event_export, compact_event_index, incremental_day_export, event_stream_source, alert_sink, score_trace_sink, score_trace_levels, calibration_artifact_table, leakage_contract_check, cross_run_summary)
}

_STREAM = """
SELECT concat('h', CAST(user_id % 4 AS VARCHAR)) AS host, event_id, user_id AS src_id, 1000000 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS dst_id,
  CASE event_type WHEN 'click' THEN 'EVENT_READ' WHEN 'view' THEN 'EVENT_OPEN' WHEN 'purchase' THEN 'EVENT_WRITE' WHEN 'signup' THEN 'EVENT_CONNECT' ELSE 'EVENT_RECVFROM' END AS action, value AS score FROM events"""
#: groups of the events before FITTED and the value of rank ceil(0.99 (n - 1)) of each
_FITTED = f"""
WITH s AS ({_STREAM}), p AS ({_STREAM} WHERE ts < TIMESTAMP '{FITTED}'),
l AS (SELECT 'host_action' AS level, host, action, score FROM p UNION ALL SELECT 'action', NULL, action, score FROM p UNION ALL SELECT 'global', NULL, NULL, score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY level, host, action ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY level, host, action) AS n FROM l),
t AS (SELECT level, host, action, n, max(CASE WHEN r = ceil(0.99 * (n - 1)) THEN score END) AS thr FROM r GROUP BY level, host, action, n)
SELECT s.host, s.event_id, s.score, coalesce(h.thr, a.thr, g.thr) AS threshold, CASE WHEN h.thr IS NOT NULL THEN 'host_action' WHEN a.thr IS NOT NULL THEN 'action' ELSE 'global' END AS threshold_level,
  CASE WHEN h.thr IS NOT NULL THEN concat(s.host, '|', s.action) WHEN a.thr IS NOT NULL THEN s.action ELSE 'all' END AS score_group
FROM s LEFT JOIN t h ON h.level = 'host_action' AND h.n >= 100 AND h.host = s.host AND h.action = s.action LEFT JOIN t a ON a.level = 'action' AND a.n >= 100 AND a.action = s.action JOIN t g ON g.level = 'global'"""
#: in terms of the audit tables (tracewell.sources.mapping), for the check
TEXTS: dict[str, str] = {
    "incremental_day_export": "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM prov_events GROUP BY 1",
    "event_stream_source": _STREAM,
    "alert_sink": f"SELECT s.host, s.event_id, s.score, CASE WHEN s.src_id IN (SELECT node_id FROM gt_nodes) THEN 1 ELSE 0 END + CASE WHEN s.dst_id IN (SELECT node_id FROM gt_nodes) THEN 1 ELSE 0 END AS label FROM ({_STREAM}) s WHERE s.score >= {THRESHOLD}",
    "score_trace_sink": f"SELECT host, event_id, score, CAST({THRESHOLD} AS DOUBLE) AS threshold, 'global' AS threshold_level, action AS score_group FROM ({_STREAM}) s",
    "score_trace_levels": _FITTED,
    "calibration_artifact_table": "SELECT action, n, thr, vmax FROM action_thresholds",
    "leakage_contract_check": "SELECT 'events' AS table_name, count(*) AS n_rows, '' AS leaks FROM prov_events UNION ALL SELECT 'flow', count(*), '' FROM flow UNION ALL SELECT 'touch', count(*), '' FROM touch "
    "UNION ALL SELECT 'thresholds', count(*), '' FROM action_thresholds UNION ALL SELECT 'labelled', count(*), 'label' FROM labeled UNION ALL SELECT 'alerts', count(*), 'label' FROM alerts",
    "cross_run_summary": "WITH e AS (SELECT l.host, l.label, l.score >= a.thr AS over FROM labeled l JOIN action_thresholds a ON a.action = l.action WHERE l.split = 'test'), m AS (SELECT host, 'strict' AS mode, over, label FROM e UNION ALL SELECT host, 'relaxed', over, label FROM e WHERE label <> 1), "
    "c AS (SELECT host AS run, mode, count_if(over AND label = 2) AS tp, count_if(over AND label <> 2) AS fp, count_if(NOT over AND label = 2) AS fn, count_if(NOT over AND label <> 2) AS tn FROM m GROUP BY host, mode) "
    "SELECT run, mode, metric, CAST(value AS DOUBLE) AS value FROM (SELECT run, mode, 'tp' AS metric, tp AS value FROM c UNION ALL SELECT run, mode, 'fp', fp FROM c UNION ALL SELECT run, mode, 'fn', fn FROM c UNION ALL SELECT run, mode, 'tn', tn FROM c) x",
}
