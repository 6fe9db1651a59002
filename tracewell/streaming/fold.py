"""Ordered folds over keyed state, with one step function for batch and for Structured Streaming.

A fold keeps, for each key (a host, or a node of a host), a map from names to lists of numbers, and sees the key's events in
order, one at a time, before it changes the state. In batch, rows are partitioned by key, sorted, and streamed through the
step, or through its form over blocks of rows (``blocks``), so a task holds the state of one key and never its events. In streaming, ``transformWithStateInPandas`` keeps
the map in the state store and only loads what a micro-batch touches.

Order in a stream. Rows wait in the state store until the watermark has passed their time, and are then folded in order, by a
timer: rows that arrive late, but within the watermark's delay, give the same result as in batch. Rows behind the watermark are
dropped by Spark before they reach a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MILLIS = "millis__"
#: rows wait in the state store by this much time
BUCKET_MILLIS = 60_000
#: names to numbers: lists or numpy arrays
States = MutableMapping[str, Sequence[float]]


@dataclass(frozen=True)
class Fold:
    key: tuple[str, ...]
    order: tuple[str, ...]
    inputs: tuple[str, ...]
    #: DDL of the rows that ``step`` returns (tuples); it may return None
    output: str
    step: Callable[[States, object], tuple | None]
    #: what batch runs instead: makes a function from a data frame of rows in order to the output's columns, with the step's results. If the host is
    #: the key there is one for each host; else one for a task, whose rows are of many keys, each key's together
    block: Callable[[], Callable[[pd.DataFrame], dict]] | None = None


def folded(events: DataFrame, fold: Fold) -> DataFrame:
    """The fold's rows over a finite table."""
    columns = list(dict.fromkeys([*fold.key, *fold.order, *fold.inputs]))
    names = T.StructType.fromDDL(fold.output).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, states = None, {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in fold.key)
                if key != at:
                    at, states = key, {}
                if (got := fold.step(states, row)) is not None:
                    out.append(got)
            yield pd.DataFrame(out, columns=names)

    def run_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken = None, None
        for pdf in batches:
            hosts = pdf["host"].to_numpy()
            cuts = [0, *(np.flatnonzero(hosts[1:] != hosts[:-1]) + 1), len(pdf)] if fold.key == ("host",) else [0, len(pdf)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if taken is None or fold.key == ("host",) and hosts[start] != at:
                    at, taken = hosts[start], fold.block()
                yield pd.DataFrame(taken(pdf.iloc[start:end]), columns=names)

    # a given number, as the size of the rows says little about the work of a step
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # hosts are few and large: by ranges two of them only share a task if there are more than tasks
    dealt = events.select(*columns).repartitionByRange(parts, "host") if fold.key == ("host",) else events.select(*columns).repartition(parts, *fold.key)
    return dealt.sortWithinPartitions(*fold.key, *fold.order).mapInPandas(run_blocks if fold.block else run, fold.output)


class _Stored(dict):
    """A view of a MapState that loads names when asked for and writes back those that were set."""

    def __init__(self, kept):
        super().__init__()
        self.kept, self.changed = kept, set()

    def __missing__(self, name: str) -> Sequence[float]:
        if not self.kept.containsKey((name,)):
            raise KeyError(name)
        value = list(self.kept.getValue((name,))[0])
        super().__setitem__(name, value)
        return value

    def pop(self, name: str, default=None):
        value = self.get(name, default)
        super().pop(name, None)
        self.changed.discard(name)
        if self.kept.containsKey((name,)):
            self.kept.removeKey((name,))
        return value

    def get(self, name: str, default=None):
        try:
            return self[name]
        except KeyError:
            return default

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or self.kept.containsKey((name,))

    def __setitem__(self, name: str, value: Sequence[float]) -> None:
        self.changed.add(name)
        super().__setitem__(name, value)

    def flush(self) -> None:
        for name in self.changed:
            self.kept.updateValue((name,), ([float(x) for x in self[name]],))


class OrderedProcessor(StatefulProcessor):
    """Rows wait until the watermark has passed them, and are then taken in order, by ``due``.

    They wait by buckets of time, each with a timer at its end, so that a row is written once more for each batch of its own bucket
    and read once. Timers come in the order of time. With ``delay_millis``, ``passed`` is called that long after each bucket, too; these timers
    are set as rows arrive, as one that is set while a timer is served comes with the next batch.
    """

    def __init__(self, schema: T.StructType, order: Sequence[str], names: Sequence[str], bucket_millis: int = BUCKET_MILLIS, delay_millis: int | None = None):
        self.schema, self.order, self.names, self.bucket_millis = schema, list(order), list(names), bucket_millis
        self.delay = None if delay_millis is None else -(-delay_millis // bucket_millis) * bucket_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows array<binary>")
        self.latest = handle.getValueState("latest", "bucket long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)[self.schema.names]
        for bucket, own in pdf.groupby(pdf[MILLIS] // self.bucket_millis, sort=True):
            at = (int(bucket),)
            held = list(self.waiting.getValue(at)[0]) if self.waiting.containsKey(at) else []
            self.waiting.updateValue(at, ([*held, _written(own)],))
            self.handle.registerTimer((int(bucket) + 1) * self.bucket_millis)
            if self.delay is not None:
                self.handle.registerTimer((int(bucket) + 1) * self.bucket_millis + self.delay)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        millis = expiredTimerInfo.getExpiryTimeInMs()
        at = (millis // self.bucket_millis - 1,)
        if self.waiting.containsKey(at):
            yield from self._taken(at)
        out = self.passed(key, millis)
        if out is not None and len(out):
            yield out[self.names]

    def _taken(self, at: tuple) -> Iterator[pd.DataFrame]:
        if self.latest.exists() and self.latest.get()[0] >= at[0]:
            raise RuntimeError(f"a timer of bucket {at[0]} after that of bucket {self.latest.get()[0]}")
        self.latest.update(at)
        pdf = pd.concat([_read(x) for x in self.waiting.getValue(at)[0]], ignore_index=True)
        self.waiting.removeKey(at)
        out = self.due(pdf.sort_values(self.order, kind="stable"))
        if len(out):
            yield out[self.names]

    def due(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def passed(self, key: tuple, millis: int) -> pd.DataFrame | None:
        """What is to be said at ``millis``, after the rows before it."""
        return None

    def close(self) -> None:
        pass


class FoldProcessor(OrderedProcessor):
    """A fold's step over the rows that are due."""

    def __init__(self, fold: Fold, schema: T.StructType):
        super().__init__(schema, fold.order, T.StructType.fromDDL(fold.output).names)
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("states", "name string", "value array<double>")

    def due(self, rows: pd.DataFrame) -> pd.DataFrame:
        states, out = _Stored(self.kept), []
        for row in rows.itertuples(index=False):
            if (got := self.fold.step(states, row)) is not None:
                out.append(got)
        states.flush()
        return pd.DataFrame(out, columns=self.names)


def _written(rows: pd.DataFrame) -> bytes:
    """Rows as the state store takes them: one Arrow stream for each batch that brings some."""
    out, table = pa.BufferOutputStream(), pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _read(written: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(written).read_all().to_pandas()


def folded_stream(events: DataFrame, fold: Fold, time: str = "ts") -> DataFrame:
    """The fold's rows over a stream with a watermark on ``time`` (state store: RocksDB); write it in append mode."""
    columns = list(dict.fromkeys([*fold.key, time, *fold.order, *fold.inputs]))
    rows = events.select(*columns, F.unix_millis(time).alias(MILLIS))
    processor = FoldProcessor(fold, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != time]))
    return rows.groupBy(*fold.key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=T.StructType.fromDDL(fold.output), outputMode="Append", timeMode="EventTime")
