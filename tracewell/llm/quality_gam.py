"""Quality classifier: a generalised additive model with pairwise interactions over features of the whole text.

Each feature is cut into quantile bins. Training goes round the features in turn, fits a shallow tree (up to four leaves) to
the loss gradient over one feature's bins, and adds a small step of it to that feature's look-up table; then the pairs that
lower the loss most get two-dimensional tables the same way, from one cut along each feature. Scoring only looks up bins
and adds: features, bins and additions are vectorised in each task, and the tables are a few kilobytes.

The model is fitted on at most SAMPLE labelled documents, the first by a hash of doc_id: that bound is the only sampling.
Documents whose crc32(doc_id) mod 5 is 0 are never learned from. Neither labels nor lang, source or doc_id are features.

Defined results. Null text is empty; empty texts get a score. Without labels of both kinds the score is the share of good
labels (0.5 without any). Rows with a null doc_id are scored, and count as not held out. Labels with nulls are left out; of
repeated labels of a document the lowest counts, of repeated rows one. An empty table gives no rows. Extra columns pass through
``scored`` and ``kept``; a column that has the score's name is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import text_bytes

SAMPLE = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS = 150, 60, 0.15, 20
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "symbols", "digits", "capitals", "points", "marks", "lines", "repeated_lines",
    "distinct_words", "top_word", "repeated_pairs", "other_bytes", "short_words", "entropy", "top_line", "byte_kinds", "pipes",
)
_SETS = {"symbols": b"#*$%&|<>~^=_{}[]\\@+", "digits": b"0123456789", "capitals": bytes(range(65, 91)), "points": b".,;:", "marks": b"!?", "lines": b"\n", "pipes": b"|"}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _SETS.items()}
_SMALL = np.isin(np.arange(256), list(range(97, 123)))


def features(text: bytes) -> list[float]:
    words = text.split()
    n, k = max(len(text), 1), max(len(words), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    of = {name: float(counts[m].sum()) for name, m in _MASKS.items()}
    small = float(counts[_SMALL].sum())
    kinds = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_kinds = Counter(lines)
    sizes = list(map(len, words))
    p = counts[counts > 0] / n
    pairs = len(words) - 1
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(sizes) / k, np.log1p(max(sizes, default=0)), of["symbols"] / n, of["digits"] / n, of["capitals"] / max(of["capitals"] + small, 1),
        of["points"] / k, of["marks"] / k, of["lines"] / k, 1 - len(line_kinds) / max(len(lines), 1), len(kinds) / k, max(kinds.values(), default=0) / k,
        1 - len(set(zip(words, words[1:]))) / pairs if pairs > 0 else 0.0, float(counts[128:].sum()) / n, sum(x <= 3 for x in sizes) / k, float(-(p * np.log2(p)).sum()),
        max((c * len(x) for x, c in line_kinds.items() if c > 1), default=0) / n, float(len(p)), of["pipes"] / k,
    ]


def feature_matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            z += table[np.searchsorted(cuts, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], side="right") for a, b, _ in self.pairs for j in (a, b)}
        for a, b, table in self.pairs:
            z += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-z))


def _quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered bins, from up to 2**depth leaves of at least LEAST_ROWS rows."""
    out = np.full(len(g), -g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl)
    gain[(nl < LEAST_ROWS) | (n.sum() - nl < LEAST_ROWS)] = -np.inf
    at = int(np.argmax(gain))
    if gain[at] <= _gain(g.sum(), h.sum()):
        return out
    return np.concatenate((_shallow_tree(g[: at + 1], h[: at + 1], n[: at + 1], depth - 1), _shallow_tree(g[at + 1 :], h[at + 1 :], n[at + 1 :], depth - 1)))


def _crossed(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best single cut along each of two features: loss drop and the four values as a table."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)

    def quarters(c):
        a, row, col, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, row - a, col - a, whole - row - col + a

    parts = list(zip(quarters(cg), quarters(ch)))
    gain = sum(_gain(a, b) for a, b in parts)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [-a[i, j] / (b[i, j] + 1.0) for a, b in parts]
    table = np.empty_like(g)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - _gain(g.sum(), h.sum())), table


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    good = float(y.mean()) if len(y) else 0.5
    if good in (0.0, 1.0) or not len(y):
        p = min(max(good, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))))
    m = Model(float(np.log(good / (1 - good))))
    m.cuts = [_quantile_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(m.cuts)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    z = np.full(len(y), m.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            k = len(m.tables[j])
            step = RATE * _shallow_tree(np.bincount(b, g, k), np.bincount(b, h, k), np.bincount(b, minlength=k))
            m.tables[j] += step
            z += step[b]
    m.pair_cuts = [_quantile_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(m.pair_cuts)]
    wide = [len(c) + 1 for c in m.pair_cuts]

    def grids(a, b, g, h):
        at = coarse[a] * wide[b] + coarse[b]
        return (np.bincount(at, v, wide[a] * wide[b]).reshape(wide[a], wide[b]) for v in (g, h))

    g, h = slopes()
    ranked = sorted(((-_crossed(*grids(a, b, g, h))[0], a, b) for a in range(x.shape[1]) for b in range(a) if wide[a] > 1 and wide[b] > 1))
    m.pairs = [(a, b, np.zeros((wide[a], wide[b]))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in m.pairs:
            g, h = slopes()
            step = RATE * _crossed(*grids(a, b, g, h))[1]
            table += step
            z += step[coarse[a], coarse[b]]
    return m


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents that have a label and aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna().where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by the parameter, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("quality", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = feature_matrix(text_bytes(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality double, x array<double>").groupBy("doc_id").agg(F.min_by("quality", "x").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").collect()
    return fit(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([float(r.quality > 0) for r in got]))


def scored(docs: DataFrame, model: Model, out: str = "gam_score") -> DataFrame:
    """The columns of ``docs``, then the score; a column of that name is replaced."""
    fields = [f for f in docs.schema.fields if f.name != out]
    at = [f.name for f in fields].index("text")
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(feature_matrix(text_bytes(b.column(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=schema.names)

    return docs.select(*(docs[f"`{f.name}`"] for f in fields)).mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(feature_matrix(text_bytes(b.column(1)))))], names=["doc_id", "score"])

    model = learned(docs, labels, sample)
    return slim.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject."""
    return scored(docs, learned(docs, labels, sample), "__gam_score").where(F.col("__gam_score") >= THRESHOLD).drop("__gam_score")
