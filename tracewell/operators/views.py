"""Several views of the same events: text policies, each with word vectors and a model of its own, joined in one distance.

A policy says which of a node's tokens are read. Each view learns word vectors and a low-rank ridge model of an event's vector
given its context on training events alone, and gives an event two components: the squared error and the cosine distance of what it
expected. Components become robust deviations over their validation median; an event's score is its Mahalanobis distance from
the validation events. Every event is scored before the states of its ends move.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import alerting, conditional, variants
from tracewell.operators.learning import action_words, fit_word2vec, mean_vectors, ridge, sentences, used_words, word_bags
from tracewell.sources.staging import stage

#: what a view tells of an event
MISSES = ("error", "cosine")
_KEYS = ["host", "event_id", "split"]


def policies(summary: DataFrame) -> dict[str, DataFrame]:
    """node_id and tokens under three policies: all that is said of a node, where it lies, and what it is.

    ``summary`` has node_id, kind and lower-case tokens (``attributes.summaries``). The latter two start with the node's kind, so
    that no node is without a token; an address lies in its scope and is its port's range.
    """
    starts = lambda *prefixes: F.filter("tokens", lambda t: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(t, p)))
    net = F.col("kind") == "netflow"
    place = F.when(net, F.slice("tokens", 1, 1)).otherwise(starts("root_", "dir_"))
    thing = F.when(net, F.slice("tokens", 2, 1)).otherwise(starts("exe_", "path_"))
    of = lambda tokens: summary.select("node_id", tokens.alias("tokens"))
    return {"whole": of(F.col("tokens")), "place": of(F.concat(F.array("kind"), place)), "thing": of(F.concat(F.array("kind"), thing))}


@dataclass
class View:
    """A policy's vectors of nodes and actions, and the weights that expect an event's vector from its context."""

    node_vectors: conditional.NodeVectors
    actions: dict[str, np.ndarray]
    weights: np.ndarray

    @classmethod
    def fit(cls, placed: DataFrame, words: DataFrame, name: str, alpha: float = 1.0, rank: int = 16) -> View:
        train = placed.where("split = 'train'")
        vectors = stage(fit_word2vec(sentences(train, words)), f"word-vectors-{name}")
        of, bags = word_bags(used_words(placed, words), vectors, "node_id")
        node_vectors = stage(of, f"bags-of-nodes-{name}"), bags
        actions = conditional.action_table(mean_vectors(action_words(placed), vectors, "action"))
        return cls(node_vectors, actions, ridge(conditional.moments(train, node_vectors, actions, None), alpha, rank))

    def misses(self, placed: DataFrame) -> DataFrame:
        """host, event_id, split, error, cosine."""
        w = self.weights

        def f(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
            p = x @ w
            cosine = (p * y).sum(1) / np.maximum(np.linalg.norm(p, axis=1) * np.linalg.norm(y, axis=1), 1e-8)
            return {"error": ((p - y) ** 2).mean(1), "cosine": 1 - cosine}

        return conditional.mapped_contexts(placed, self.node_vectors, self.actions, f, MISSES)


@dataclass
class MultiView:
    views: dict[str, View]

    @classmethod
    def fit(cls, placed: DataFrame, words: dict[str, DataFrame], alpha: float = 1.0, rank: int = 16) -> MultiView:
        """A view for each policy's ``words`` (node_id, tokens)."""
        # a host's stream is one task's work, so views are fitted side by side
        with ThreadPoolExecutor(max(1, len(words))) as pool:
            return cls(dict(zip(words, pool.map(lambda name: View.fit(placed, words[name], name, alpha, rank), words))))

    @property
    def columns(self) -> list[str]:
        return [f"{v}_{m}" for v in self.views for m in MISSES]

    def components(self, placed: DataFrame) -> DataFrame:
        """host, event_id, split and each view's misses; the views' rows meet in one grouping."""
        each = None
        for name, view in self.views.items():
            rows = view.misses(placed).select(*_KEYS, F.lit(name).alias("view"), *MISSES)
            each = rows if each is None else each.unionByName(rows)
        of = lambda v, m: F.max(F.when(F.col("view") == v, F.col(m))).alias(f"{v}_{m}")
        return each.groupBy(*_KEYS).agg(*(of(v, m) for v in self.views for m in MISSES))


def deviations(rows: DataFrame, columns: list[str], reference: DataFrame, most: float = 20.0, digits: int = 6) -> DataFrame:
    """Each column as robust deviations over the reference rows' median: 0 below it, at most ``most``.

    Medians are of values rounded to ``digits`` decimal places, so that values in them, not rows, are what is ordered.
    """
    long = reference.select(F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.round(c, digits).alias("score")) for c in columns))).alias("r")).select("r.*")
    stats = {r["component"]: (r["median"], r["mad"]) for r in alerting.robust_stats(long.where("score IS NOT NULL"), ["component"], {}).collect()}
    # without reference rows there is nothing to deviate from
    z = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(most), (F.col(c) - stats[c][0]) / (1.4826 * stats[c][1]))) if c in stats else F.lit(0.0)
    return rows.withColumns({c: z(c) for c in columns})


def fused(rows: DataFrame, columns: list[str], reference: DataFrame, most: float = 20.0) -> DataFrame:
    """host, event_id, distance, each component's part of its square, the component with the largest, and the score: the mean of the positive parts, at most ``most``."""
    every = lambda df: deviations(df, columns, reference, most)
    found = variants.mahalanobis(every(rows), columns, every(reference))
    mean = F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.greatest(p, F.lit(0.0))) / len(columns)
    return found.withColumn("score", F.least(F.lit(most), mean))
