"""How far each part of an event's rarity is to be trusted: gates learned on events and their perturbed twins.

Components are rarities by counts of training events, -ln of a smoothed share of *what* among events with the same *given*. Twins are
events made from true ones by swapping the action or the destination with another event's or by moving the time; they are
scored by the very components. A component's gate is a logistic function of all components' deviations. Gates are learned such
that a twin's gated sum of deviations exceeds its event's by a margin, at a small cost for every gate that is open: a component
that can't see any perturbation closes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators import alerting, profiles
from tracewell.operators.flow import order
from tracewell.operators.learning import adam_step, matrix, summed_rows
from tracewell.operators.variants import mapped_rows
from tracewell.sources.staging import stage

#: component: (given, what); columns of ``with_gaps``
COMPONENTS = {
    "action": (["src_kind", "dst_kind"], ["action"]),
    "kind": (["src_kind", "action"], ["dst_kind"]),
    "pair": (["info_src"], ["info_dst"]),
    "object": (["action"], ["info_dst"]),
    "gap": (["action"], ["gap"]),
}
#: rows of a host that may swap with each other, and how many of those after it an event looks at
BUCKET, AHEAD = 4096, 8
#: count tables up to so many rows are sent to all tasks; rows of pairs that are packed in one
FEW, PACKED = 10_000, 4096
_KEYS = ["host", "event_id"]
_FLOW = ["host", "event_id", "split", "ts_us", "action", "info_src", "info_dst", "src_kind", "dst_kind"]


def gap_bucket(us: Column) -> Column:
    """log2 of the seconds since the source's last event, rounded down, 0 under two seconds; -1 for its first."""
    return F.when(us.isNull(), -1).when(us < 2_000_000, 0).otherwise(F.floor(F.log2(us / 1e6))).cast("int")


def with_gaps(flow: DataFrame) -> DataFrame:
    """The flow's columns that components read, gap_us since the source's last event as a source (null for its first) and its bucket."""
    last = F.lag("ts_us").over(Window.partitionBy("host", "info_src").orderBy(*order()))
    return flow.select(*_FLOW).withColumn("gap_us", F.col("ts_us") - last).withColumn("gap", gap_bucket(F.col("gap_us")))


def twins(rows: DataFrame, salt: str = "twin", least: int = 6, most: int = 16) -> DataFrame:
    """Rows as ``with_gaps`` gives them, perturbed, with the column ``twin``: which of action, object and time was.

    Events are dealt by a hash into buckets of about BUCKET rows of a host, and in a bucket ordered by another. An event takes the first
    other action, or the first other destination with its kind, among the AHEAD events after it; one that has none has no
    such twin. Time is moved by 2 to the power of ``least`` to ``most`` seconds, drawn by a hash. The same rows give the same twins.
    """
    n = rows.groupBy("host").agg(F.ceil(F.count("*") / BUCKET).alias("__buckets"))
    h = F.xxhash64("event_id", F.lit(salt))
    dealt = rows.join(n, "host").withColumn("__h", h).withColumn("__bucket", F.pmod(F.xxhash64("__h"), F.col("__buckets")))
    after = Window.partitionBy("host", "__bucket").orderBy("__h", "event_id").rowsBetween(1, AHEAD)
    seen = dealt.withColumn("__next", F.collect_list(F.struct("action", "info_dst", "dst_kind")).over(after))
    other = lambda c: F.get(F.filter("__next", lambda e: e[c] != F.col(c)), F.lit(0))
    moved = F.coalesce("gap_us", F.lit(0)) + (F.pow(F.lit(2.0), least + F.pmod(F.col("__h"), F.lit(most - least + 1))) * 1_000_000).cast("long")
    rest = [c for c in rows.columns if c not in ("action", "info_dst", "dst_kind", "gap_us", "gap")]
    as_is = {c: F.col(c) for c in ("action", "info_dst", "dst_kind", "gap_us", "gap")}
    one = lambda name, **new: F.struct(F.lit(name).alias("twin"), *(v.alias(k) for k, v in (as_is | new).items()))
    a, o = other("action"), other("info_dst")
    made = F.array(
        F.when(a.isNotNull(), one("action", action=a["action"])), F.when(o.isNotNull(), one("object", info_dst=o["info_dst"], dst_kind=o["dst_kind"])), one("time", gap_us=moved, gap=gap_bucket(moved)),
    )
    return seen.select(*rest, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("t")).select(*rest, "t.*")


@dataclass
class Rarities:
    """Counts of training events for each component; tables are as long as there are distinct keys and joined by key, those of FEW rows in each task."""

    components: dict[str, tuple[list[str], list[str]]]
    tables: dict[str, tuple[DataFrame, DataFrame, int]]

    @classmethod
    def fit(cls, train: DataFrame, components: dict[str, tuple[list[str], list[str]]] = COMPONENTS) -> Rarities:
        tables = {}
        for name, (given, what) in components.items():
            both = stage(profiles.counts(train, [*given, *what]), f"counts-{name}")
            alone = stage(both.groupBy(*given).agg(F.sum("c").alias("c")), f"given-{name}")
            tables[name] = *(F.broadcast(t) if t.count() <= FEW else t for t in (both, alone)), both.select(*what).distinct().count() + 1
        return cls(components, tables)

    def of(self, rows: DataFrame) -> DataFrame:
        """Adds a column for each component: -ln((events with given and what + 1) / (events with given + distinct what + 1))."""
        for name, (given, what) in self.components.items():
            both, alone, distinct = self.tables[name]
            rows = profiles.with_count(profiles.with_count(rows, both, [*given, *what], "__both"), alone, given, "__given")
            rows = rows.withColumn(f"c_{name}", profiles.nll("__both", F.coalesce("__given", F.lit(0)) + F.lit(float(distinct)))).drop("__both", "__given")
        return rows


@dataclass
class Gate:
    """Gates of k components over their deviations z: floor + (1 - floor) sigmoid(W f(z)), f(z) = (ln(1 + z), share of z over 2, 1).

    The margin is in deviations; the cost is of each open gate, and must outweigh the decay of weights, or closed gates drift open.
    """

    weights: np.ndarray
    floor: float = 0.02
    margin: float = 6.0
    cost: float = 0.05
    decay: float = 1e-5

    @classmethod
    def new(cls, k: int, seed: int = 23, **parameters) -> Gate:
        return cls(np.random.default_rng(seed).normal(0, 0.01, (k, k + 2)), **parameters)

    def features(self, z: np.ndarray) -> np.ndarray:
        return np.column_stack((np.log1p(z), (z > 2).mean(axis=1), np.ones(len(z))))

    def gates(self, z: np.ndarray) -> np.ndarray:
        return self._open(self.features(z))[0]

    def _open(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = 1 / (1 + np.exp(-np.clip(f @ self.weights.T, -30, 30)))
        return self.floor + (1 - self.floor) * s, (1 - self.floor) * s * (1 - s)

    def gradient(self, z: np.ndarray, twin: np.ndarray) -> np.ndarray:
        """Summed loss of the pairs, their number, and the summed loss's gradient by the weights."""
        n = len(z)
        out, scores, parts = self.decay * n * (self.weights**2).sum(), [], []
        for x in (z, twin):
            f = self.features(x)
            g, slope = self._open(f)
            scores.append((g * x).sum(axis=1))
            parts.append((f, slope, x))
            out += self.cost * g.sum() / 2
        short = np.maximum(0, self.margin - (scores[1] - scores[0]))
        grad = 2 * self.decay * n * self.weights
        for (f, slope, x), sign in zip(parts, (1, -1)):
            grad = grad + (slope * (2 * sign * short[:, None] * x + self.cost / 2)).T @ f
        return np.concatenate(([out + (short**2).sum(), n], grad.ravel()))


def packed_pairs(pairs: DataFrame) -> DataFrame:
    """Deviations ``z`` and ``t`` of up to PACKED pairs as one row of bytes: what rounds read again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, PACKED):
                part = b.slice(k, PACKED)
                yield pa.RecordBatch.from_arrays([pa.array([matrix(part.column(i)).tobytes()], pa.binary()) for i in (0, 1)], names=["z", "t"])

    return pairs.select("z", "t").mapInArrow(run, "z binary, t binary")


def pair_gradients(packed: DataFrame, gate: Gate) -> np.ndarray:
    """The sum of ``gate.gradient`` over all pairs."""
    k = len(gate.weights)

    def part(b: pa.RecordBatch) -> np.ndarray:
        return sum(gate.gradient(*(np.frombuffer(x.as_buffer(), float).reshape(-1, k) for x in pair)) for pair in zip(*b.columns))

    return summed_rows(packed, part, 2 + gate.weights.size)


@dataclass
class Reliability:
    """What is learned: rarities, each component's usual value and spread, and the gates."""

    rarities: Rarities
    usual: dict[str, tuple[float, float]]
    gate: Gate
    losses: list[float] = field(default_factory=list)
    most: float = 20.0

    @property
    def names(self) -> list[str]:
        return list(self.rarities.components)

    def deviations(self, rows: DataFrame) -> DataFrame:
        """Adds z: for each component the deviations over its usual value, from 0 to ``most``."""
        return self._deviations(self.rarities.of(rows))

    def _deviations(self, rows: DataFrame) -> DataFrame:
        z = [F.greatest(F.lit(0.0), F.least(F.lit(self.most), (F.col(f"c_{n}") - m) / s)) for n, (m, s) in self.usual.items()]
        return rows.withColumn("z", F.array(*z)).drop(*(f"c_{n}" for n in self.names))

    @classmethod
    def fit(cls, flow: DataFrame, components: dict[str, tuple[list[str], list[str]]] = COMPONENTS, learn: str = "validation", rounds: int = 40, rate: float = 0.1, least_spread: float = 0.25, **gate) -> Reliability:
        """Counts are of training events; usual values and gates are learned on those of ``learn``, which the counts have not met.

        A deviation is at least ``least_spread`` (in nats), so that a component that hardly varies doesn't saturate. A closed gate must
        not meet the margin by itself, or nothing would be learned.

        ``flow`` may be as ``with_gaps`` gives it. A round is one pass over the written pairs; the driver gets a sum of gradients, k x (k + 2)
        numbers for k components.
        """
        rows = flow if "gap" in flow.columns else stage(with_gaps(flow).where(F.col("split").isin("train", learn)), "with-gaps")
        rarities = Rarities.fit(rows.where("split = 'train'"), components)
        events = rows.where(F.col("split") == learn)
        normal = stage(rarities.of(events), "rarities")
        long = normal.select(F.explode(F.array(*(F.struct(F.lit(n).alias("component"), F.round(f"c_{n}", 6).alias("score")) for n in components))).alias("r")).select("r.*")
        spread = {r["component"]: r["s"] for r in long.groupBy("component").agg(F.stddev_pop("score").alias("s")).collect()}
        stats = {r["component"]: (r["median"], max(1.4826 * r["mad"], spread[r["component"]] / 4, least_spread)) for r in alerting.robust_stats(long, ["component"], {}).collect()}
        found = cls(rarities, {n: stats.get(n, (0.0, 1.0)) for n in components}, Gate.new(len(components), **gate))
        if found.gate.floor * found.most >= found.gate.margin:
            raise ValueError("a closed gate meets the margin: lower the floor or the largest deviation")
        if not stats:
            return found
        # a twin carries its event's deviations
        own = found._deviations(normal).drop("split", "ts_us").withColumnRenamed("z", "own")
        pairs = stage(packed_pairs(found.deviations(twins(own)).select(F.col("own").alias("z"), F.col("z").alias("t"))), "pairs")
        w = found.gate.weights
        moments = [(np.zeros_like(w), np.zeros_like(w))]
        for t in range(1, rounds + 1):
            now = Gate(w.copy(), found.gate.floor, found.gate.margin, found.gate.cost, found.gate.decay)
            g = pair_gradients(pairs, now)
            if not g[1]:
                break
            found.losses.append(float(g[0] / g[1]))
            adam_step([w], g, moments, t, rate)
        return found

    def scores(self, rows: DataFrame) -> DataFrame:
        """host, event_id, score (the gated sum of deviations), gates and parts by component, top: the largest part's component.

        ``rows`` are as ``with_gaps`` gives them; a column ``twin`` is kept.
        """
        keys, names, gate = [c for c in (*_KEYS, "twin") if c in rows.columns], np.array(self.names), self.gate

        def f(pdf: pd.DataFrame) -> pd.DataFrame:
            z = np.stack(pdf["z"].to_numpy())
            g = gate.gates(z)
            parts = g * z
            return pdf[keys].assign(score=parts.sum(axis=1), gates=g.tolist(), parts=parts.tolist(), top=names[parts.argmax(axis=1)])

        types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
        return mapped_rows(self.deviations(rows).select(*keys, "z"), f, f"{types}, score double, gates array<double>, parts array<double>, top string")

    def summary(self, rows: DataFrame) -> DataFrame:
        """component, its mean gate and mean part over ``rows``, and the loss of the pairs at first and at last."""
        names = F.array(*map(F.lit, self.names))
        each = self.scores(rows).select(F.explode(F.arrays_zip(names.alias("component"), F.col("gates").alias("gate"), F.col("parts").alias("part"))).alias("r")).select("r.*")
        ends = [self.losses[i] if self.losses else None for i in (0, -1)]
        return each.groupBy("component").agg(F.avg("gate").alias("gate"), F.avg("part").alias("part")).withColumns({"first_loss": F.lit(ends[0]).cast("double"), "last_loss": F.lit(ends[1]).cast("double")})
