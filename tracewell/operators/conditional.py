"""The conditional scorer: contexts of learned vectors and evolving node states, heads by target case, scores.

Vectors. Nodes and actions have unit mean word vectors (``learning``). An event's vector is the mean of its source's, action's and
destination's; it is what moves states. Before an event, an end that is active is represented by the mean of its own
vector and its state, any other by its own vector alone; the context is both representations and both kinds. If either end is active,
the target to be predicted is the event's vector (case ``event_semantic``), else the action's (``both_cold_action``).

States. The source takes rho times the event's vector; the destination the unit vector of the event's vector and lambda
times what the source's state was; a loop is one update with the latter. Processes are active from their second event
on, other nodes from their third, or their second if they were a source. States of nodes that aren't active grow, but read as 0.

Blocks. Only events that share a node depend on each other. A host's stream is taken in blocks; a block's events are dealt to
levels (one more than the latest level of their ends), and a level, which touches each node once, is one array operation. Neither
blocks nor levels change what is computed. A host remains one task, as its nodes read each other's states, but a task
takes its events some tens at a time, and heads are applied to whole blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.learning import Head, Kept, Moments, action_words, added_up, fit_word2vec, gathered, is_packed, learned_together, matrix, mean_vectors, packed, packed_sum, sentences, used_words, word_bags
from tracewell.sources.staging import stage
from tracewell.streaming.blocks import Places, Rows, levels
from tracewell.streaming.fold import MILLIS, OrderedProcessor
from tracewell.streaming.folds import KEEP, LAMBDA, RHO, SCALE

KINDS = list(SCALE)
CASES = ("event_semantic", "both_cold_action")
BLOCK = 8192
#: vectors of a host in memory; others are in a file
VECTORS = 1 << 18


@dataclass
class Heads:
    """A low-rank head for each target case, and the actions' vectors."""

    by_case: dict[str, Head]

    def distance(self, x: np.ndarray, y: np.ndarray, is_event: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for case, rows in zip(CASES, (is_event, ~is_event)):
            if rows.any():
                out[rows] = self.by_case[case].distance(x[rows], y[rows])
        return out


@dataclass(frozen=True)
class UpdateGate:
    """States take an event's messages times 1 up to the score ``limit``, falling by e each 1 / ``slope`` beyond it, ``least`` at least."""

    limit: float
    least: float = 0.05
    slope: float = 1.0

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.where(score <= self.limit, 1.0, np.maximum(self.least, np.exp(-self.slope * np.maximum(score - self.limit, 0))))


@dataclass
class Block:
    """Events as arrays: places of their ends in the host's states, numbers of action and kinds."""

    src: np.ndarray
    dst: np.ndarray
    action: np.ndarray
    src_kind: np.ndarray
    dst_kind: np.ndarray


@dataclass
class HostStates:
    """A host's nodes: their own vectors, states, and how often they were touched, and touched as a source."""

    actions: dict[str, np.ndarray]
    heads: Heads | None = None
    gate: UpdateGate | None = None
    place: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.names = {a: i for i, a in enumerate(sorted(self.actions))}
        self.size = len(next(iter(self.actions.values())))
        self.action_vectors = np.stack([self.actions[a] for a in sorted(self.actions)])
        self.lam = np.array([LAMBDA.get(a, 0.0) for a in sorted(self.actions)])
        self.rho = np.array([RHO.get(a, 0.0) for a in sorted(self.actions)])
        self.scale = np.array(list(SCALE.values()))
        self.keep = KEEP[: self.size]
        self.own, self.state = np.zeros((0, self.size)), np.zeros((0, self.size))
        self.touched, self.as_source = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, nodes: list[int]) -> np.ndarray:
        place = self.place
        for n in nodes:
            if n not in place:
                place[n] = len(place)
        if len(place) > len(self.own):
            more = max(len(place), 2 * len(self.own)) - len(self.own)
            self.own = np.concatenate((self.own, np.zeros((more, self.size))))
            self.state = np.concatenate((self.state, np.zeros((more, self.size))))
            self.touched = np.concatenate((self.touched, np.zeros(more, np.int64)))
            self.as_source = np.concatenate((self.as_source, np.zeros(more, np.int64)))
        return np.array([place[n] for n in nodes], np.int64)

    def block(self, src: np.ndarray, dst: np.ndarray, rows: pa.RecordBatch) -> Block:
        """``rows`` (_EVENT) whose ends have these places."""
        kind = {k: i for i, k in enumerate(KINDS)}

        def numbers(name: str, of: Callable[[str], int]) -> np.ndarray:
            c = rows.column(name).dictionary_encode("encode")
            return np.array([of(k) for k in c.dictionary.to_pylist()], np.int64)[c.indices.to_numpy()]

        return Block(src, dst, numbers("action", self.names.__getitem__), *(numbers(c, lambda k: kind.get(k, kind["unknown"])) for c in ("src_kind", "dst_kind")))

    def step(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Contexts, targets, whether the case is ``event_semantic``, and scores (with heads); states move on."""
        n, d, process = len(b.src), self.size, KINDS.index("process")
        z = (self.own[b.src] + self.action_vectors[b.action] + self.own[b.dst]) / 3
        scale = self.scale[b.src_kind]
        lam, rho = self.lam[b.action] * scale, self.rho[b.action] * scale
        x = np.zeros((n, 2 * d + 2 * len(KINDS)))
        x[np.arange(n), 2 * d + b.src_kind] = 1
        x[np.arange(n), 2 * d + len(KINDS) + b.dst_kind] = 1
        y, is_event, score = z.copy(), np.zeros(n, bool), np.zeros(n)
        level = levels(b.src.tolist(), b.dst.tolist())
        order = np.argsort(level, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
            s, t = b.src[at], b.dst[at]
            on_s, on_t = (
                np.where(kind == process, self.touched[node] >= 1, (self.touched[node] >= 2) | (self.as_source[node] >= 1))
                for node, kind in ((s, b.src_kind[at]), (t, b.dst_kind[at]))
            )
            held_s, held_t = self.state[s] * on_s[:, None], self.state[t] * on_t[:, None]
            x[at, :d] = (self.own[s] + held_s) / np.where(on_s, 2.0, 1.0)[:, None]
            x[at, d : 2 * d] = (self.own[t] + held_t) / np.where(on_t, 2.0, 1.0)[:, None]
            is_event[at] = on_s | on_t
            q = 1.0
            if self.gate is not None:
                cold = ~is_event[at]
                y[at[cold]] = self.action_vectors[b.action[at[cold]]]
                score[at] = self.heads.distance(x[at], y[at], is_event[at])
                q = self.gate(score[at])[:, None]
            to = z[at] + lam[at, None] * held_s
            norm = np.sqrt((to * to).sum(axis=1, keepdims=True))
            to = to / np.where(norm > 1e-8, norm, 1.0)
            apart = s != t
            a, qa = at[apart], q if self.gate is None else q[apart]
            self.state[s[apart]] = self.keep * self.state[s[apart]] + (1 - self.keep) * qa * (rho[a, None] * z[a])
            self.state[t] = self.keep * self.state[t] + (1 - self.keep) * q * to
            self.touched[s] += 1
            self.as_source[s] += 1
            self.touched[t[apart]] += 1
        y[~is_event] = self.action_vectors[b.action[~is_event]]
        if self.heads is not None and self.gate is None:
            score = self.heads.distance(x, y, is_event)
        return x, y, is_event, score if self.heads is not None else None


class HostMemory:
    """A host's nodes in a batch run: states and vectors as rows that are taken for a block and put back (``streaming.blocks.Rows``), so that a task
    holds a bounded number of them in memory and 40 bytes of any node. Nodes that share a vector share its row; unknown nodes have none (zeros)."""

    def __init__(self, actions: dict[str, np.ndarray], heads: Heads | None, gate: UpdateGate | None):
        self.states = HostStates(actions, heads, gate)
        d = self.states.size
        self.nodes, self.bags, self.vectors, self.held = Places(), Places(), Rows(d, VECTORS), Rows(d + 2)
        self.vector_of = np.zeros(0, np.int64)

    def share(self, bags: np.ndarray, vectors: np.ndarray) -> None:
        """Vectors by number."""
        (at,) = self.bags(pd.Series(bags))
        order = np.argsort(at)
        self.vectors.take(at[order])
        self.vectors.put(at[order], vectors[order])

    def _vectors_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (at,) = self.nodes(pd.Series(nodes))
        if len(self.nodes) > len(self.vector_of):
            self.vector_of = np.concatenate((self.vector_of, np.full(max(len(self.nodes), 2 * len(self.vector_of)) - len(self.vector_of), -1)))
        return at, self.vector_of[at]

    def know(self, nodes: np.ndarray, bags: np.ndarray) -> None:
        """Numbers of nodes' vectors."""
        at, _ = self._vectors_of(nodes)
        (self.vector_of[at],) = self.bags(pd.Series(bags))

    def step(self, rows: pa.RecordBatch) -> tuple:
        """``HostStates.step`` of a block's events."""
        s, ends = self.states, np.concatenate([rows.column(c).to_numpy() for c in ("info_src", "info_dst")])
        at, number = self._vectors_of(ends)
        nodes, first, back = np.unique(at, return_index=True, return_inverse=True)
        number = number[first]
        known, which = np.unique(number[number >= 0], return_inverse=True)
        s.own = np.zeros((len(nodes), s.size))
        s.own[number >= 0] = self.vectors.take(known)[which]
        h = self.held.take(nodes)
        s.state, s.touched, s.as_source = h[:, : s.size], h[:, s.size].astype(np.int64), h[:, s.size + 1].astype(np.int64)
        found = s.step(s.block(*np.split(back, 2), rows))
        h[:, s.size], h[:, s.size + 1] = s.touched, s.as_source
        self.held.put(nodes, h)
        return found


_EVENT = ["event_id", "ts_us", "split", "action", "src_kind", "dst_kind", "info_src", "info_dst"]
_FLOW = "host string, event_id long, ts_us long, split string, action string, src_kind string, dst_kind string, info_src long, info_dst long, target_case string"
_CONTEXT = f"{_FLOW}, x array<double>, y array<double>"
_SCORE = f"{_FLOW}, score double"


def action_table(vectors: DataFrame) -> dict[str, np.ndarray]:
    """The actions' vectors: as many rows as there are scored actions."""
    return {r["action"]: np.array(r["embedding"]) for r in vectors.collect()}


#: of a block: rows (_FLOW without target_case), x, y, whether the case is event_semantic, scores (with heads)
Blocks = Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]


#: node_id and embedding; or node_id and its bag's number, with each number's vector (``learning.word_bags``)
NodeVectors = DataFrame | tuple[DataFrame, DataFrame]


def own_vectors(node_vectors: NodeVectors) -> DataFrame:
    """node_id and embedding."""
    if not isinstance(node_vectors, tuple):
        return node_vectors
    of, bags = node_vectors
    return of.join(bags, "bag").select("node_id", "embedding")


def _known(placed: DataFrame, node_vectors: NodeVectors) -> DataFrame:
    """What comes before a host's events: each vector that its nodes share, once, at -2; and its nodes, at -1, with their vector or its number."""
    ends = placed.select("host", F.explode(F.array_distinct(F.array("info_src", "info_dst"))).alias("node_id")).distinct()
    if not isinstance(node_vectors, tuple):
        return ends.join(node_vectors, "node_id").select("host", F.lit(-1).cast("long").alias("stream_pos"), "node_id", F.lit(None).cast("long").alias("bag"), "embedding")
    of, bags = node_vectors
    held = stage(ends.join(of, "node_id").select("host", "node_id", "bag"), "ends")
    shared = held.select("host", "bag").distinct().join(bags, "bag")
    nodes = held.select("host", F.lit(-1).cast("long").alias("stream_pos"), "node_id", "bag", F.lit(None).cast("array<double>").alias("embedding"))
    return nodes.unionByName(shared.select("host", F.lit(-2).cast("long").alias("stream_pos"), F.lit(None).cast("long").alias("node_id"), "bag", "embedding"))


def over_contexts(placed: DataFrame, node_vectors: NodeVectors, actions: dict[str, np.ndarray], f: Callable[[Blocks], Iterator[pa.RecordBatch]], schema: str, split: str | None = None, heads: Heads | None = None, gate: UpdateGate | None = None, block: int = BLOCK) -> DataFrame:
    """What ``f`` makes of the blocks of the hosts that a task has; contexts are used where they arise and never leave the task.

    Each host's stream is taken in order. Vectors that nodes share come first, once each, then a host's nodes, then its events. With ``split``, ``f`` sees
    the events of that split alone, while all events move the states.
    """
    rows = _known(placed, node_vectors).unionByName(placed.select("host", "stream_pos", *_EVENT), allowMissingColumns=True)
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("host", "stream_pos", "node_id", "bag", "embedding", *_EVENT).repartition(parts, "host").sortWithinPartitions("host", "stream_pos")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Blocks:
        at_host, memory = None, None
        for b in batches:
            if not b.num_rows:
                continue
            hosts, phase = b.column(0).to_pylist(), np.minimum(b.column(1).to_numpy(), 0)
            cuts = [i for i in range(b.num_rows) if i == 0 or hosts[i] != hosts[i - 1] or phase[i] != phase[i - 1]]
            for start, end in zip(cuts, [*cuts[1:], b.num_rows]):
                if at_host != (hosts[start],):
                    at_host, memory = (hosts[start],), HostMemory(actions, heads, gate)
                part = b.slice(start, end - start)
                if phase[start] == -2:
                    memory.share(part.column(3).to_numpy(), matrix(part.column(4)))
                    continue
                if phase[start] == -1:
                    own = not part.column(4).null_count  # a vector for each node
                    if own:
                        memory.share(part.column(2).to_numpy(), matrix(part.column(4)))
                    memory.know(part.column(2).to_numpy(), part.column(2 if own else 3).to_numpy())
                    continue
                for k in range(0, len(part), block):
                    of = part.slice(k, block).select(["host", *_EVENT])
                    found = memory.step(of)
                    if split is None:
                        yield of, *found
                    elif len(at := np.flatnonzero(np.array(of.column("split").to_pylist()) == split)):
                        yield of.take(pa.array(at)), *(None if v is None else v[at] for v in found)

    return dealt.mapInArrow(lambda batches: f(blocks(batches)), schema)


def replayed(placed: DataFrame, node_vectors: NodeVectors, actions: dict[str, np.ndarray], heads: Heads | None = None, gate: UpdateGate | None = None, block: int = BLOCK, split: str | None = None) -> DataFrame:
    """Contexts (x, y) of the events, or with ``heads`` their scores."""
    return over_contexts(placed, node_vectors, actions, lambda found: (_as_rows(*b) for b in found), _SCORE if heads is not None else _CONTEXT, split, heads, gate, block)


def mapped_contexts(placed: DataFrame, node_vectors: NodeVectors, actions: dict[str, np.ndarray], f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], columns: Sequence[str], split: str | None = None) -> DataFrame:
    """host, event_id, split and the columns of numbers that ``f`` makes of x and y."""

    def run(found: Blocks) -> Iterator[pa.RecordBatch]:
        for rows, x, y, *_ in found:
            made = f(x, y)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("host", "event_id", "split")), *(pa.array(made[c]) for c in columns)], names=["host", "event_id", "split", *columns])

    return over_contexts(placed, node_vectors, actions, run, f"host string, event_id long, split string, {', '.join(f'{c} double' for c in columns)}", split)


def moments(placed: DataFrame, node_vectors: NodeVectors, actions: dict[str, np.ndarray], split: str | None = "train") -> Moments:
    """The moments of the contexts of a split: what least squares learns from, without a context being written."""
    d = len(next(iter(actions.values())))
    p, q = 2 * d + 2 * len(KINDS), d

    def run(found: Blocks) -> Iterator[pa.RecordBatch]:
        total = np.zeros(Moments.size(p, q))
        for _, x, y, *_ in found:
            total += Moments.part(x, y)
        yield packed_sum(total)

    found = Moments.unpacked(added_up(over_contexts(placed, node_vectors, actions, run, "a array<double>", split), Moments.size(p, q)), p, q)
    if not found.n:
        raise ValueError("there are no contexts to learn from")
    return found


def packed_contexts(placed: DataFrame, node_vectors: NodeVectors, actions: dict[str, np.ndarray], split: str | None = "train") -> DataFrame:
    """target_case and contexts x, y packed in single precision: what heads are learned on; tasks keep them for all passes."""

    def run(found: Blocks) -> Iterator[pa.RecordBatch]:
        for _, x, y, is_event, _ in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.where(is_event, *CASES).tolist(), pa.string()), packed(x), packed(y)], names=["target_case", "x", "y"])

    return over_contexts(placed, node_vectors, actions, run, "target_case string, x binary, y binary", split)


def _arrays(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))


def _as_rows(rows: pa.RecordBatch, x: np.ndarray, y: np.ndarray, is_event: np.ndarray, score: np.ndarray | None) -> pa.RecordBatch:
    own = [rows.column(c) for c in ("host", *_EVENT)] + [pa.array(np.where(is_event, *CASES).tolist(), pa.string())]
    found = {"score": pa.array(np.round(score, 9))} if score is not None else {"x": _arrays(x), "y": _arrays(y)}
    return pa.RecordBatch.from_arrays([*own, *found.values()], names=["host", *_EVENT, "target_case", *found])


class ScoreProcessor(OrderedProcessor):
    """The same over a stream: a host's nodes are in keyed state, and only those that a bucket of rows touches are loaded."""

    def __init__(self, schema: T.StructType, actions: dict[str, np.ndarray], heads: Heads, gate: UpdateGate | None):
        super().__init__(schema, ("ts_us", "event_id"), T.StructType.fromDDL(_SCORE).names)
        self.actions, self.heads, self.gate = actions, heads, gate

    def init(self, handle) -> None:
        super().init(handle)
        self.nodes = handle.getMapState("nodes", "node_id long", "own array<double>, state array<double>, touched long, as_source long")

    def due(self, rows: pd.DataFrame) -> pd.DataFrame:
        states = HostStates(self.actions, self.heads, self.gate)
        vectors = dict(zip(rows["info_src"].tolist(), rows["src_vector"])) | dict(zip(rows["info_dst"].tolist(), rows["dst_vector"]))
        nodes = list(vectors)
        states.places(nodes)
        for k, node in enumerate(nodes):
            if self.nodes.containsKey((node,)):
                own, state, states.touched[k], states.as_source[k] = self.nodes.getValue((node,))
                states.own[k], states.state[k] = own, state
            elif vectors[node] is not None:
                states.own[k] = vectors[node]
        of = pa.RecordBatch.from_pandas(rows[["host", *_EVENT]], preserve_index=False)
        ends = (states.places(of.column(c).to_pylist()) for c in ("info_src", "info_dst"))
        found = _as_rows(of, *states.step(states.block(*ends, of))).to_pandas()
        for k, node in enumerate(nodes):
            self.nodes.updateValue((node,), (states.own[k].tolist(), states.state[k].tolist(), int(states.touched[k]), int(states.as_source[k])))
        return found


@dataclass
class Scorer:
    """What is learned: nodes' and actions' vectors and the heads. It scores finite tables and streams alike."""

    node_vectors: NodeVectors
    actions: dict[str, np.ndarray]
    heads: Heads
    gate: UpdateGate | None = None
    losses: list[dict[str, float]] = field(default_factory=list)

    @classmethod
    def fit(cls, placed: DataFrame, words: DataFrame, **training) -> Scorer:
        """Learned on the training events alone; ``words`` has node_id and tokens."""
        train = placed.where("split = 'train'")
        vectors = stage(fit_word2vec(sentences(train, words)), "word-vectors")
        of, bags = word_bags(used_words(placed, words), vectors, "node_id")
        node_vectors = stage(of, "bags-of-nodes"), bags
        actions = action_table(mean_vectors(action_words(placed), vectors, "action"))
        heads, losses = fit_heads(packed_contexts(train, node_vectors, actions, None), **training)
        return cls(node_vectors, actions, heads, losses=losses)

    @property
    def own_vectors(self) -> DataFrame:
        """node_id and embedding."""
        return own_vectors(self.node_vectors)

    def scores(self, placed: DataFrame) -> DataFrame:
        """The flow's columns with target_case and score."""
        return replayed(placed, self.node_vectors, self.actions, self.heads, self.gate)

    def scored_stream(self, events: DataFrame, time: str = "ts") -> DataFrame:
        """The same rows of a stream of flow events with a watermark on ``time`` (state store: RocksDB), in append mode."""
        named = lambda end: self.own_vectors.select(F.col("node_id").alias(f"info_{end}"), F.col("embedding").alias(f"{end}_vector"))
        rows = events.join(named("src"), "info_src", "left").join(named("dst"), "info_dst", "left")
        rows = rows.select("host", time, *_EVENT, "src_vector", "dst_vector", F.unix_millis(time).alias(MILLIS))
        processor = ScoreProcessor(T.StructType([f for f in rows.schema.fields if f.name != time]), self.actions, self.heads, self.gate)
        return rows.groupBy("host").transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=T.StructType.fromDDL(_SCORE), outputMode="Append", timeMode="EventTime"
        )


def fit_heads(contexts: DataFrame, rank: int = 32, loss: str = "cosine", epochs: int = 80, rate: float = 0.05, patience: int = 5, clip: float = 5.0, seed: int = 23) -> tuple[Heads, list[dict[str, float]]]:
    """A head for each target case, and each epoch's mean loss by case.

    ``contexts`` has target_case, x and y: arrays, or as ``packed_contexts`` gives them. Full-batch Adam, both heads in one pass over the rows for each epoch; tasks tell each other a sum of gradients,
    as long as the heads' parameters. It stops when the loss over all rows hasn't fallen by 1e-4 for ``patience`` epochs. A case without rows keeps its
    first weights.
    """

    def made(p: int, q: int) -> Heads:
        return Heads({c: Head(p, q, rank, seed + i, loss) for i, c in enumerate(CASES)})

    def learn(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        kept = {c: Kept() for c in CASES}
        for b in batches:
            cases, x, y = np.array(b.column(0).to_pylist()), matrix(b.column(1)), matrix(b.column(2))
            for c, of in kept.items():
                if (rows := cases == c).any():
                    of.add(x[rows], y[rows], is_packed(b.column(1)))
        p, q = (int(n) for n in np.max(gathered(np.max([(k.inputs, k.outputs) for k in kept.values()], axis=0)), axis=0))
        if not p:
            return None
        heads = made(p, q).by_case
        moments = {c: [(np.zeros_like(v), np.zeros_like(v)) for v in h.parameters] for c, h in heads.items()}
        losses, best, stale, steps = [], np.inf, 0, dict.fromkeys(CASES, 0)
        for _ in range(epochs):
            own = np.zeros((len(CASES), heads[CASES[0]].gradient_size))
            for i, c in enumerate(CASES):
                for x, y in kept[c].blocks():
                    own[i] += heads[c].gradient(x, y)
            g = np.sum(gathered(own.ravel()), axis=0).reshape(own.shape)
            total = g[:, 0].sum() / g[:, 1].sum()
            losses.append([total, *(g[i, 0] / g[i, 1] if g[i, 1] else 0.0 for i in range(len(CASES)))])
            stale = 0 if total < best - 1e-4 else stale + 1
            best = min(best, total)
            if stale >= patience:
                break
            for i, c in enumerate(CASES):
                if g[i, 1]:
                    steps[c] += 1
                    heads[c].moved(g[i], moments[c], steps[c], rate, clip)
        return np.concatenate(([p, q, len(losses)], np.ravel(losses), *(h.packed for h in heads.values())))

    found = learned_together(contexts.select("target_case", "x", "y"), learn)
    if found is None:
        raise ValueError("there are no contexts to learn from")
    p, q, n = (int(v) for v in found[:3])
    heads, at = made(p, q), 3 + n * (1 + len(CASES))
    for head, numbers in zip(heads.by_case.values(), np.split(found[at:], len(CASES))):
        head.unpack(numbers)
    return heads, [dict(zip(("all", *CASES), map(float, row))) for row in found[3:at].reshape(n, -1)]
