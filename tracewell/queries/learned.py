"""Registered queries of the online scorers, clusters and learning variants; most have no SQL and are tested against plain code."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import policies
from tracewell.operators import alerting, attributes, clusters, conditional, evaluation, learning, online, reliability, saved, variants, views
from tracewell.operators import relational as rel
from tracewell.sources.audit import BY_ACTION, Audit
from tracewell.sources.staging import shared_dir, stage
from tracewell.streaming import merging
from tracewell.streaming.fold import folded
from tracewell.streaming.folds import KEEP, REALDIAG_KEEP, D, P, message

def _words(a: Audit) -> DataFrame:
    return stage(attributes.summaries(a.nodes), "words")


def _scorer(a: Audit) -> conditional.Scorer:
    return conditional.Scorer.fit(a.narrow, _words(a))


def online_conditional_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test events scored by learned heads over vectors and states, and decided: threshold, level, suppression, decision, priority."""
    a = Audit.of(spark, sf_dir)
    found = online.conditional_scoring(_scorer(a).scores(a.narrow), a.nodes, *policies.tables(spark))
    return found.select("host", "event_id", "score", "target_case", "threshold", "threshold_level", "is_alert", "is_suppressed", "decision", "priority", "is_final")


def saved_scorer_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test events decided by a scorer that was fitted, saved with its thresholds and history, and loaded against the events it was learned on."""
    a, at = Audit.of(spark, sf_dir), f"{shared_dir(spark)}/scorer-{uuid.uuid4().hex}"
    placed = stage(a.narrow, "placed")
    saved.save(saved.Deployed.of(conditional.Scorer.fit(placed, _words(a)), placed, a.nodes), placed, at)
    found = saved.load(spark, at, placed).judged(placed, a.nodes, *policies.tables(spark))
    return found.select("host", "event_id", "score", "target_case", "threshold", "threshold_level", "is_alert", "is_suppressed", "decision", "priority", "is_final")


def online_residual_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, node_id and the pool of surprisals of test events."""
    return online.residual_scoring(Audit.of(spark, sf_dir).placed, P.rate * 12000, 12000.0)[1]


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Audit.of(spark, sf_dir)
    return online.attack_evidence(alerting.with_threshold(a.placed, a.thresholds, BY_ACTION), rel.mapped("action", rel.FAMILIES, "other"))


def attack_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.node_evidence_risk(_evidence(spark, sf_dir).where("split = 'test'"))


def cascade_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Audit.of(spark, sf_dir)
    return online.cascades(alerting.alerts(a.test, a.thresholds, BY_ACTION))


def _shared(a: Audit, merged: merging.Merging = merging.Merging(), keep: np.ndarray = KEEP) -> DataFrame:
    return stage(folded(a.placed, merging.merging_fold(merged, keep)), "shared-states")


def state_merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, node_id, kind, n and the state that the node holds in the end, alone or with others."""
    return clusters.last_places(_shared(Audit.of(spark, sf_dir)))


def state_compression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.compression(clusters.last_places(_shared(Audit.of(spark, sf_dir))))


def alert_merge_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Audit.of(spark, sf_dir)
    return clusters.alert_places(alerting.alerts(a.test, a.thresholds, BY_ACTION), _shared(a)).select("host", "event_id", "src_cluster", "dst_cluster", "same_cluster")


def _vectors(a: Audit, words: DataFrame) -> DataFrame:
    return stage(learning.fit_word2vec(learning.sentences(a.flow.where("split = 'train'"), words)), "word-vectors")


def fit_word2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token and its vector, learned on the training events' tokens."""
    a = Audit.of(spark, sf_dir)
    return _vectors(a, _words(a))


def node_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit mean word vectors of the nodes that events touch."""
    a = Audit.of(spark, sf_dir)
    words = _words(a)
    return learning.mean_vectors(learning.used_words(a.flow, words), _vectors(a, words), "node_id")


def action_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Audit.of(spark, sf_dir)
    return learning.mean_vectors(learning.action_words(a.flow), _vectors(a, _words(a)), "action")


def embed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id and the unit mean of the word vectors of every node's tokens; nodes without a known token have no row."""
    a = Audit.of(spark, sf_dir)
    words = _words(a)
    return learning.mean_vectors(words, _vectors(a, words), "node_id")


def _stream(a: Audit) -> tuple:
    """The placed flow, its nodes' vectors (by number of their bag of words) and its actions': what contexts are made of."""
    words = _words(a)
    vectors = _vectors(a, words)
    nodes = learning.word_bags(learning.used_words(a.narrow, words), vectors, "node_id")
    return a.narrow, nodes, conditional.action_table(learning.mean_vectors(learning.action_words(a.narrow), vectors, "action"))


def conditional_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, event_id and the context of every event: what its ends are and hold, and their kinds: 136 numbers."""
    return conditional.replayed(*_stream(Audit.of(spark, sf_dir))).select("host", "event_id", F.col("x").alias("context"))


def conditional_train_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, event_id, target_case, context x and target y of the training events."""
    return conditional.replayed(*_stream(Audit.of(spark, sf_dir)), split="train").select("host", "event_id", "target_case", "x", "y")


def fit_conditional_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch and mean loss, of all rows and by target case."""
    losses = conditional.fit_heads(conditional.packed_contexts(*_stream(Audit.of(spark, sf_dir))))[1]
    return spark.createDataFrame([(i, *x.values()) for i, x in enumerate(losses)], "epoch int, loss double, event_semantic double, both_cold_action double")


def apply_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, event_id, target_case and the distance between predicted and actual target vectors of the test events."""
    a = Audit.of(spark, sf_dir)
    return _scorer(a).scores(a.narrow).where("split = 'test'").select("host", "event_id", "target_case", "score")


def fit_ridge_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = learning.ridge(conditional.moments(*_stream(Audit.of(spark, sf_dir))))
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(w)], "input int, weights array<double>")


def mean_cov_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, scale and inverse ridge covariance of all dimensions of the embeddings."""
    return learning.mean_cov(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.pca_2d(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the isotonic fit of attack labels on validation scores."""
    return learning.isotonic_steps(Audit.of(spark, sf_dir).labelled.where("split = 'validation'").select("score", (F.col("label") > 0).cast("int").alias("label")))


def transfer_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one host out: test nodes by a class-weighted logistic model of the other hosts' nodes."""
    a = Audit.of(spark, sf_dir)
    bad = a.truth.select("node_id").distinct().withColumn("bad", F.lit(1.0))
    rows = a.node_scores.join(bad, "node_id", "left").select("host", "node_id", F.coalesce("bad", F.lit(0.0)).alias("label"), F.log1p("support").alias("log_support"), "node_score")
    return learning.leave_one_out(rows, ["log_support", "node_score"]).select("host", "node_id", "label", "probability")


def action_nll_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-ln P(action | kinds) by a multinomial logistic model."""
    return learning.action_nll(Audit.of(spark, sf_dir).flow)


def fit_lowrank_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = conditional.packed_contexts(*_stream(Audit.of(spark, sf_dir)))
    return spark.createDataFrame(list(enumerate(variants.fit_lowrank(contexts, epochs=30)[2])), "epoch int, loss double")


def fit_als_lowrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = variants.alternating_least_squares(conditional.moments(*_stream(Audit.of(spark, sf_dir))))
    return spark.createDataFrame([(n, i, [float(x) for x in row]) for n, m in (("inputs", u), ("outputs", v.T)) for i, row in enumerate(m)], "factor string, i int, weights array<double>")


def lowrank_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(Audit.of(spark, sf_dir))
    m = conditional.moments(*stream)
    u, v = variants.alternating_least_squares(m)
    model = u @ v, *variants.principal_directions(m), D
    return conditional.mapped_contexts(*stream, lambda x, y: variants.component_columns(x, y, *model), variants.COMPONENTS, "test").drop("split")


def multi_view_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test events by how far three text policies' models miss them together: distance, each component's part, score."""
    a = Audit.of(spark, sf_dir)
    placed = stage(a.narrow, "placed")
    model = views.MultiView.fit(placed, views.policies(_words(a)))
    components = stage(model.components(placed), "view-components")
    return views.fused(components.where("split = 'test'"), model.columns, components.where("split = 'validation'"))


_EVIDENCE = ["excess", "peers", "actions", "transitions"]


def evidence_composer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(_evidence(spark, sf_dir).select("host", "event_id", "split", *(F.log1p(c).alias(c) for c in _EVIDENCE)), "evidence")
    return variants.mahalanobis(rows.where("split = 'test'"), _EVIDENCE, rows.where("split = 'validation'"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow with gaps, written once for counts, pairs and scores."""
    return stage(reliability.with_gaps(Audit.of(spark, sf_dir).flow), "with-gaps")


def reliability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """component, its mean gate and part over test events, and the loss of the pairs of events and perturbed twins, at first and at last."""
    rows = _gaps(spark, sf_dir)
    return reliability.Reliability.fit(rows).summary(rows.where("split = 'test'"))


def reliability_gated_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, event_id, score, gates, parts and top component of the test events."""
    rows = _gaps(spark, sf_dir)
    return reliability.Reliability.fit(rows).scores(rows.where("split = 'test'"))


def fit_realdiag_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dimension, gamma and time constant of the states' decay, learned on training events; and the loss before and after."""
    gamma, losses = variants.fit_gamma(Audit.of(spark, sf_dir).touch.where("split = 'train'"), message, D)
    rows = [(i, float(g), float(1 / g), losses[0], losses[-1]) for i, g in enumerate(gamma)]
    return spark.createDataFrame(rows, "dimension int, gamma double, tau double, first_loss double, last_loss double")


def node_pair_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, event_id and the distance between the vector that a low-rank head expects of the pair of ends and the event's own."""
    stream = _stream(Audit.of(spark, sf_dir))
    head, scale, _ = variants.fit_scaled(conditional.moments(*stream), epochs=30)
    return conditional.mapped_contexts(*stream, lambda x, y: {"distance": head.distance(x / scale, y)}, ["distance"], "test").drop("split")


def case_loss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conditional head's loss on test events by target case."""
    losses = apply_head(spark, sf_dir).select("host", "event_id", F.col("score").alias("loss"))
    return evaluation.case_losses(losses, Audit.of(spark, sf_dir).cased)


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state_model, mode, host and the states that a run which merges saves against the run of the same state model that doesn't."""
    a = Audit.of(spark, sf_dir)
    a.placed  # placed once, for all runs
    kept = {(model, mode): keep for model, keep in (("ema", KEEP), ("realdiag", REALDIAG_KEEP)) for mode in ("fourier", "time_domain")}
    # a host's stream is one task's work, so runs go side by side
    with ThreadPoolExecutor(len(kept)) as pool:
        shared = dict(zip(kept, pool.map(lambda run: _shared(a, merging.Merging(run[1]), kept[run]), kept)))
    each = [clusters.compression(clusters.last_places(s)).select(F.lit(model).alias("state_model"), F.lit(mode).alias("mode"), "host", "logical_states", "physical_states", "bytes_saved") for (model, mode), s in shared.items()]
    runs = reduce(DataFrame.unionByName, each)
    # a run that merges nothing keeps a state for each node
    saved = F.col("logical_states") - F.col("physical_states")
    return runs.select("state_model", "mode", "host", "physical_states", saved.alias("saved_states"), (100.0 * saved / F.col("logical_states")).alias("saved_pct"), "bytes_saved")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        online_conditional_scoring, saved_scorer_decisions, online_residual_scoring, attack_evidence, cascade_confirmation,
        state_merge_clusters, state_compression_summary, alert_merge_analysis, run_comparison,
        fit_word2vec, embed_tokens, node_embeddings, action_embeddings,
        conditional_context, conditional_train_matrix, fit_conditional_head, apply_head, case_loss_summary,
        fit_lowrank_residual, fit_als_lowrank, fit_ridge_svd, lowrank_components, multi_view_score, evidence_composer, reliability_gate, reliability_gated_score,
        fit_realdiag_gamma, node_pair_head, action_nll_head, transfer_logistic, isotonic_calibration, pca_2d, mean_cov_fit,
    )
}
