"""Ordered numbers and running sums of large groups without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracewell.sources.staging import stage


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column | str], written: bool = False) -> DataFrame:
    """Adds, for each name in ``sums``, the sum of a whole number over the rows of the same keys up to and with this one in ``order``.

    Rows are range-partitioned by keys and order, so a group of any size spreads over tasks, which add up their rows
    while they stream by. One total for each task and group in it is then added up and joined back. ``order`` should be total within
    the keys; ties are taken in any order. Range partitioning samples its input, so the rows are written first, unless they are
    ``written`` already: what they are computed from is computed once. Pass the columns that are needed, no more.
    """
    names = list(sums)
    df = df if written else stage(df, "ordered")
    added = df.withColumns({f"__v{i}": F.coalesce(F.expr(v) if isinstance(v, str) else v, F.lit(0)).cast("long") for i, v in enumerate(sums.values())})
    first = len(df.columns)
    schema = T.StructType([*added.schema.fields, T.StructField("__task", T.IntegerType()), T.StructField("__at", T.LongType()), *(T.StructField(f"__upto{i}", T.LongType()) for i in range(len(names)))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at, total = TaskContext.get().partitionId(), 0, [0] * len(names)
        for b in batches:
            extra = [pa.array(np.full(b.num_rows, task, np.int32)), pa.array(np.arange(at, at + b.num_rows))]
            for i in range(len(names)):
                upto = total[i] + np.cumsum(b.column(first + i).to_numpy(zero_copy_only=False).astype(np.int64))
                total[i] = int(upto[-1]) if len(upto) else total[i]
                extra.append(pa.array(upto))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=schema.names)

    placed = added.repartitionByRange(partitions(df), *(F.col(k) for k in keys), *order).sortWithinPartitions(*(F.col(k) for k in keys), *order)
    local = stage(placed.mapInArrow(add_up, schema), "running")
    before = [F.min_by(F.col(f"__upto{i}") - F.col(f"__v{i}"), "__at").alias(f"__before{i}") for i in range(len(names))]
    totals = local.groupBy("__task", *keys).agg(*before, *(F.sum(f"__v{i}").alias(f"__sum{i}") for i in range(len(names))))
    # one row for each task and group in it: as many as tasks and groups together
    earlier = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    shift = [(F.coalesce(F.sum(f"__sum{i}").over(earlier), F.lit(0)) - F.col(f"__before{i}")).alias(f"__shift{i}") for i in range(len(names))]
    # written, so that the planner knows their size and sends them to all tasks if they are few
    bases = totals.select(F.col("__task").alias("__t"), *(F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)), *shift)
    bases = stage(bases, "bases")
    on = F.col("__task") == F.col("__t")
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    return local.join(bases, on).select(*df.columns, *((F.col(f"__upto{i}") + F.col(f"__shift{i}")).alias(n) for i, n in enumerate(names)))


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str, start: int = 1, written: bool = False) -> DataFrame:
    """Adds the place of each row among those of the same keys, in ``order``; native, by the rows' numbers in their tasks. ``written`` as in ``running``."""
    df = df if written else stage(df, "ordered")
    sort = [*(F.col(k) for k in keys), *order]
    local = stage(df.repartitionByRange(partitions(df), *sort).sortWithinPartitions(*sort).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    task, at = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each task and group in it: as many as tasks and groups together
    totals = local.groupBy(task.alias("__t"), *(F.col(k).alias(f"__k{j}") for j, k in enumerate(keys))).agg(F.count("*").alias("__c"), F.min(at).alias("__first"))
    earlier = Window.partitionBy(*(f"__k{j}" for j in range(len(keys)))).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__t", *(f"__k{j}" for j in range(len(keys))), (F.coalesce(F.sum("__c").over(earlier), F.lit(0)) - F.col("__first")).alias("__base"))
    bases = stage(bases, "bases")
    on = task == F.col("__t")
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    return local.join(bases, on).select(*df.columns, (F.col("__base") + at + start).alias(out))


def share_above(df: DataFrame, keys: list[str], value: str, is_reference: Column) -> DataFrame:
    """Adds n_above and n_reference: reference rows of the same keys with at least this value, and all of them.

    Equal values are one row in the ordered part.
    """
    df = stage(df.withColumn("__is", is_reference), "values-of")
    is_reference = F.col("__is")
    counts = stage(df.groupBy(*keys, value).agg(F.count_if(is_reference).alias("__ref")), "values")
    above = running(counts, keys, [F.col(value).desc()], {"n_above": "__ref"}, written=True).drop("__ref")
    total = counts.groupBy(*keys).agg(F.sum("__ref").alias("n_reference"))
    return df.drop("__is").join(above, [*keys, value]).join(total, keys)
