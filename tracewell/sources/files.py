"""Readers of files that come with an audit: ground truth in either delimiter, and metrics of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_truth(spark: SparkSession, paths: list[str]) -> DataFrame:
    """uuid, info, old_index of all files: tab-separated lines where there is a tab, else comma-separated; headers, blank lines and blank uuids are left out."""
    lines = spark.read.text(paths)
    parts = F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split("value", ","))
    cell = lambda i: F.nullif(F.trim(F.get("parts", F.lit(i))), F.lit(""))
    rows = lines.select(parts.alias("parts")).select(cell(0).alias("uuid"), cell(1).alias("info"), cell(2).alias("old_index"))
    return rows.where("uuid IS NOT NULL AND lower(uuid) <> 'uuid'").distinct()


METRICS = "run string, metrics map<string, map<string, double>>"


def cross_run_summary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """run, mode, metric, value: the metrics files (JSON, an object a line) of any number of runs as one table."""
    runs = spark.read.schema(METRICS).json(paths)
    modes = runs.select("run", F.explode("metrics").alias("mode", "values"))
    return modes.select("run", "mode", F.explode("values").alias("metric", "value"))
