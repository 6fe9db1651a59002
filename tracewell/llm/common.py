"""Staging in the shared folder, distributed prefix sums and small Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.staging import shared_dir, stage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged_at(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """A written and reread copy, and its folder."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def emptied(spark: SparkSession, path: str) -> None:
    """Free what a staged folder holds, once a later one has all that is needed of it."""
    spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(binary).to_pylist()]


def sized_blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive [start, end) ranges of rows whose sizes sum to ``most`` at most (or one larger row)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def running_offsets(df: DataFrame, order: list[str], size: str, out: str, label: str) -> DataFrame:
    """Add ``out``, the sum of ``size`` over all rows that come before in ``order`` (a total order), without a global window.

    Rows are range-partitioned and sorted; each task adds up its own rows while they stream by. The totals, one row per
    partition, are then summed and joined back, so that what is gathered depends on the number of partitions alone.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("__pid", T.IntegerType()), T.StructField("__before", T.LongType())])
    at = df.columns.index(size)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), pid, np.int32)), pa.array(before)], names=[*b.schema.names, "__pid", "__before"])

    parts = shuffle_partitions(df.sparkSession)
    local = stage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(add_up, schema), label)
    totals = local.groupBy("__pid").agg(F.sum(size).alias("__sum"))
    # one row per partition: bounded by the number of partitions, whatever the input
    a, b = totals.alias("a"), totals.alias("b")
    bases = a.join(F.broadcast(b), F.col("b.__pid") < F.col("a.__pid"), "left").groupBy(F.col("a.__pid").alias("__pid")).agg(F.coalesce(F.sum("b.__sum"), F.lit(0)).alias("__base"))
    return local.join(F.broadcast(bases), "__pid").withColumn(out, F.col("__base") + F.col("__before")).drop("__pid", "__before", "__base")
