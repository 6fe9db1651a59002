"""Alerts confirmed by further alerts at one of their ends, within a bounded delay.

An alert opens a candidate at each of its ends (an anchor) that has none. Further alerts at the anchor join it and extend it: it ends
``seconds`` after its last alert, ``most_seconds`` after its first at most, or with its ``most_events``-th alert. It is confirmed
by the alert with which it has ``least_events`` of ``least_kinds`` kinds (action and other end's kind) of evidence, and its anchor is
then done; else it expires at its end, and the next alert opens another. Each candidate gives one row. Consistency is the
share of its alerts that are as far over their thresholds as the first.

In a stream, rows wait for the watermark, and a timer ``seconds`` after each lets its candidate expire without a further alert; a
finite table is followed by the end of time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.streaming.fold import MILLIS, OrderedProcessor

_ROW = "host string, node_id long, decision string, at_us long, event_id long, first_event long, n_events int, n_kinds int, consistency double, events array<long>"
_ALERT = ["host", "node_id", "ts_us", "event_id", "action", "peer_kind", "excess"]


@dataclass(frozen=True)
class Cascade:
    seconds: float = 2592000.0
    most_seconds: float = 4 * 2592000.0
    most_events: int = 50
    least_events: int = 2
    least_kinds: int = 2

    def end(self, held: list) -> int:
        """When a candidate (its alerts as [event, us, action, kind, excess]) ends."""
        return int(min(held[-1][1] + self.seconds * 1e6, held[0][1] + self.most_seconds * 1e6))

    def row(self, host: str, node: int, decision: str, at: int, held: list) -> tuple:
        kinds = len({(x[2], x[3]) for x in held})
        same = sum(x[4] >= held[0][4] for x in held) / len(held)
        return host, node, decision, at, held[-1][0], held[0][0], len(held), kinds, same, [x[0] for x in held]

    def expired(self, host: str, node: int, state: dict, now: float) -> tuple | None:
        """The open candidate's row if it has ended by ``now``."""
        held = state["held"]
        if not held or now <= self.end(held):
            return None
        state["held"] = []
        return self.row(host, node, "expired", self.end(held), held)

    def step(self, state: dict, e) -> list[tuple]:
        if state["done"]:
            return []
        out = []
        if gone := self.expired(e.host, int(e.node_id), state, e.ts_us):
            out.append(gone)
        held = state["held"] = [*state["held"], [int(e.event_id), int(e.ts_us), e.action, e.peer_kind, float(e.excess)]]
        if len(held) >= self.least_events and len({(x[2], x[3]) for x in held}) >= self.least_kinds:
            out.append(self.row(e.host, int(e.node_id), "confirmed", int(e.ts_us), held))
            state["done"], state["held"] = True, []
        elif len(held) >= self.most_events:
            out.append(self.row(e.host, int(e.node_id), "expired", int(e.ts_us), held))
            state["held"] = []
        return out


def _new() -> dict:
    return {"held": [], "done": False}


def cascaded(touched: DataFrame, cascade: Cascade = Cascade()) -> DataFrame:
    """The rows of a finite table of alert touches (with excess, the score over the threshold)."""
    names = T.StructType.fromDDL(_ROW).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, _new()
        for pdf in batches:
            out = []
            for e in pdf.itertuples(index=False):
                if at != (e.host, e.node_id):
                    if at and (gone := cascade.expired(*at, state, float("inf"))):
                        out.append(gone)
                    at, state = (e.host, e.node_id), _new()
                out += cascade.step(state, e)
            yield pd.DataFrame(out, columns=names)
        if at and (gone := cascade.expired(*at, state, float("inf"))):
            yield pd.DataFrame([gone], columns=names)

    parts = int(touched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return touched.select(*_ALERT).repartition(parts, "host", "node_id").sortWithinPartitions("host", "node_id", "ts_us", "event_id").mapInPandas(run, _ROW)


class CascadeProcessor(OrderedProcessor):
    def __init__(self, cascade: Cascade, schema: T.StructType):
        super().__init__(schema, ("ts_us", "event_id"), T.StructType.fromDDL(_ROW).names, delay_millis=round(cascade.seconds * 1000))
        self.cascade = cascade

    def init(self, handle) -> None:
        super().init(handle)
        self.state = handle.getValueState("candidate", "held string")

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else _new()

    def _keep(self, state: dict) -> None:
        self.state.update((json.dumps(state),))

    def due(self, rows: pd.DataFrame) -> pd.DataFrame:
        state, out = self._load(), []
        for e in rows.itertuples(index=False):
            out += self.cascade.step(state, e)
        self._keep(state)
        return pd.DataFrame(out, columns=self.names)

    def passed(self, key: tuple, millis: int) -> pd.DataFrame:
        state = self._load()
        gone = self.cascade.expired(key[0], int(key[1]), state, millis * 1000)
        if gone:
            self._keep(state)
        return pd.DataFrame([gone] if gone else [], columns=self.names)


def cascaded_stream(touched: DataFrame, cascade: Cascade = Cascade(), time: str = "ts") -> DataFrame:
    """The same over a stream with a watermark on ``time`` (state store: RocksDB), in append mode."""
    rows = touched.select(*_ALERT, time, F.unix_millis(time).alias(MILLIS))
    processor = CascadeProcessor(cascade, T.StructType([f for f in rows.schema.fields if f.name != time]))
    return rows.groupBy("host", "node_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType.fromDDL(_ROW), outputMode="Append", timeMode="EventTime"
    )


def confirmed_events(rows: DataFrame) -> DataFrame:
    """host, event_id, at_us: each event of a confirmed candidate once, with when it was first confirmed."""
    return rows.where("decision = 'confirmed'").select("host", F.explode("events").alias("event_id"), "at_us").groupBy("host", "event_id").agg(F.min("at_us").alias("at_us"))
