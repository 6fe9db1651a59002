"""Evaluation of scored, labelled events and ranked nodes. Labels only ever meet scores here.

Scored events: host, event_id, score, label (0 benign, 1 suspect, 2 attack) and the flow's columns. Alerts have thr (their threshold)
as well. Groups are given by ``by``; nothing is ranked or sorted by group in one task. A measure without positives, or
without rows, is null or 0 as stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators.prefix import numbered, running

POSITIVE = "label > 0"


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def rates(df: DataFrame) -> DataFrame:
    """Adds precision and recall to tp, fp, fn; 0 where undefined."""
    return df.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def ranked(scored: DataFrame, by: list[str], score: str = "score", ties: str = "event_id", positive: str = POSITIVE, keep: tuple[str, ...] = ()) -> DataFrame:
    """by, score, ties, is_positive, the columns to ``keep``, rk (1 is the highest score) and tp (positives up to and with this row).

    Only these columns are written and ordered.
    """
    columns = list(dict.fromkeys([*by, score, ties, *keep]))
    rows = scored.select(*columns, F.coalesce(F.expr(positive), F.lit(False)).alias("is_positive"))
    return running(rows, by, [F.col(score).desc(), F.col(ties)], {"rk": F.lit(1), "tp": F.col("is_positive").cast("int")})


def average_precision(scored: DataFrame, by: list[str], positive: str = POSITIVE, **order: str) -> DataFrame:
    """by, positives, average_precision: mean over positives of the precision at their rank; null without positives."""
    p = F.col("is_positive")
    return ranked(scored, by, positive=positive, **order).groupBy(*by).agg(F.count_if(p).alias("positives"), (F.sum(F.when(p, F.col("tp") / F.col("rk")).otherwise(0.0)) / F.nullif(F.count_if(p), F.lit(0))).alias("average_precision"))


def roc_auc(scored: DataFrame, by: list[str], positive: str = POSITIVE, **order: str) -> DataFrame:
    """by, auc in its rank-sum form; null without both classes."""
    p = F.col("is_positive")
    n, n_pos = F.count("*"), F.count_if(p)
    up = (n + 1) * n_pos - F.sum(F.when(p, F.col("rk")).otherwise(0))
    return ranked(scored, by, positive=positive, **order).groupBy(*by).agg(((up - n_pos * (n_pos + 1) / 2.0) / F.nullif(n_pos * (n - n_pos).cast("double"), F.lit(0.0))).alias("auc"))


def confusion(rows: DataFrame, by: list[str], alert: str, positive: str) -> DataFrame:
    """by, tp, fp, fn, tn."""
    a, p = F.expr(alert), F.expr(positive)
    return rows.groupBy(*by).agg(F.count_if(a & p).alias("tp"), F.count_if(a & ~p).alias("fp"), F.count_if(~a & p).alias("fn"), F.count_if(~a & ~p).alias("tn"))


def _modes(rows: DataFrame, keep_relaxed: str) -> DataFrame:
    """Each row as strict, and as relaxed if it isn't to be ignored there."""
    return rows.withColumn("mode", F.explode(F.when(F.expr(keep_relaxed), F.array(F.lit("strict"), F.lit("relaxed"))).otherwise(F.array(F.lit("strict")))))


def event_confusion(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, mode, tp ... fpr of events with thr; strict: a suspect event is negative; relaxed: it is ignored."""
    c = confusion(_modes(scored, "label <> 1"), [*by, "mode"], "score >= thr", "label = 2")
    return rates(c).withColumn("fpr", _ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def node_sets(scored: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, node_id, positive, suspect, alerted (0 or 1) of every observed node."""
    ends = scored.select(*by, "label", (F.col("score") >= F.col("thr")).alias("over"), F.explode(F.array_distinct(F.array("info_src", "info_dst"))).alias("node_id"))
    seen = ends.groupBy(*by, "node_id").agg(F.max((F.col("label") == 1).cast("int")).alias("suspect"), F.max(F.col("over").cast("int")).alias("alerted"))
    bad = truth.select("node_id").distinct().withColumn("positive", F.lit(1))
    return seen.join(bad, "node_id", "left").withColumn("positive", F.coalesce("positive", F.lit(0)))


def node_confusion(scored: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, mode, tp ... recall of observed nodes; nodes of the truth that were never seen aren't missed; relaxed ignores suspects."""
    sets = node_sets(scored, truth, by)
    return rates(confusion(_modes(sets, "positive = 1 OR suspect = 0"), [*by, "mode"], "alerted = 1", "positive = 1"))


def actor_confusion(scored: DataFrame, by: list[str], actor: str = "actor_id") -> DataFrame:
    """by, tp ... recall of actors: alerted or positive if any of their events is."""
    actors = scored.groupBy(*by, actor).agg(F.bool_or(F.expr(POSITIVE)).alias("pos"), F.bool_or(F.col("score") >= F.col("thr")).alias("alerted"))
    return rates(confusion(actors, by, "alerted", "pos"))


def recall_at_k(scored: DataFrame, by: list[str], ks: list[int], positive: str = POSITIVE, **order: str) -> DataFrame:
    """by, k, recall: the share of positives among the k highest scores; null without positives."""
    p = F.col("is_positive")
    at = [F.count_if((F.col("rk") <= k) & p).alias(str(k)) for k in ks]
    counts = ranked(scored, by, positive=positive, **order).groupBy(*by).agg(F.count_if(p).alias("__p"), *at)
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("n")) for k in ks))
    return counts.select(*by, "__p", F.explode(rows).alias("r")).select(*by, "r.k", (F.col("r.n") / F.nullif(F.col("__p").cast("double"), F.lit(0.0))).alias("recall"))


def _at_ks(rows: DataFrame, ks: list[int], name: str = "k") -> DataFrame:
    """Each row with rk once for each k that reaches it."""
    return rows.withColumn(name, F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: F.col("rk") <= k)))


def topk_precision(nodes: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """by, k, tp, fp, precision of ranked nodes (rk, is_bad)."""
    bad = F.col("is_bad") == 1
    return _at_ks(nodes, ks).groupBy(*by, "k").agg(F.count_if(bad).alias("tp"), F.count_if(~bad).alias("fp"), F.avg(F.col("is_bad").cast("double")).alias("precision"))


def topk_sweep(nodes: DataFrame, by: list[str], ks: list[int], fp_cap: int = 1000) -> DataFrame:
    """by, k, tp, fp, fn, precision, recall, and the place of each k under a cap of false positives."""
    bad = F.col("is_bad") == 1
    counts = nodes.groupBy(*by).agg(*(F.struct(F.lit(k).alias("k"), F.count_if((F.col("rk") <= k) & bad).alias("tp"), F.count_if((F.col("rk") <= k) & ~bad).alias("fp"), F.count_if((F.col("rk") > k) & bad).alias("fn")).alias(str(k)) for k in ks))
    rows = counts.select(*by, F.explode(F.array(*(F.col(f"`{k}`") for k in ks))).alias("r")).select(*by, "r.*")
    best = Window.partitionBy(*by).orderBy(F.when(F.col("fp") < fp_cap, F.col("tp")).otherwise(-1).desc(), "fp")  # a row for each k
    return rates(rows).withColumn("rank_under_cap", F.rank().over(best))


def budget_tail(scored: DataFrame, by: list[str], budgets: list[int]) -> DataFrame:
    """by, budget and what is among that many highest scores: counts, precision, score at the budget, actors found, first hit's rank."""
    p = F.col("is_positive")
    return _at_ks(ranked(scored, by, keep=("actor_id",)), budgets, "budget").groupBy(*by, "budget").agg(
        F.count("*").alias("selected"), F.count_if(p).alias("tp"), F.count_if(~p).alias("fp"), F.avg(p.cast("double")).alias("precision"), F.min("score").alias("threshold"),
        F.count_distinct(F.when(p, F.col("actor_id"))).alias("tp_actors"), F.min(F.when(p, F.col("rk"))).alias("first_tp_rank"),
    )


def top_events(scored: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n events with the highest scores of each group, with rk: partial top-n before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "event_id"))
    return scored.withColumn("rk", place).where(F.col("rk") <= n)


def rank_nodes(nodes: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Nodes with a node_score over 0, with rk and is_bad."""
    bad = truth.select("node_id").distinct().withColumn("is_bad", F.lit(1))
    marked = nodes.where("node_score > 0").join(bad, "node_id", "left").withColumn("is_bad", F.coalesce("is_bad", F.lit(0)))
    return numbered(marked, by, [F.col("node_score").desc(), F.col("node_id")], "rk")


def window_metrics(alerts: DataFrame, windows: DataFrame) -> DataFrame:
    """name, n_alerts, detected, seconds_to_detect for each attack window (name, start_ts, end_ts); bounds are inclusive, windows few."""
    hits = alerts.where(POSITIVE).select("event_id", "ts", "ts_us")
    on = F.col("ts").between(F.col("start_ts"), F.col("end_ts"))
    found = F.broadcast(windows).join(hits, on).groupBy("name").agg(F.count("event_id").alias("n_alerts"), F.min("ts_us").alias("first"))
    start = F.unix_micros(F.col("start_ts").cast("timestamp"))
    return windows.join(found, "name", "left").select("name", F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"), F.col("n_alerts").isNotNull().alias("detected"), ((F.col("first") - start) / 1000000.0).alias("seconds_to_detect"))


def categorical_lift(alerts: DataFrame, features: dict[str, Column]) -> DataFrame:
    """feature, value, n, tp, fp, fp_per_tp; null without true positives."""
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in features.items()))
    p = F.expr(POSITIVE)
    return alerts.select("label", F.explode(rows).alias("f")).groupBy("f.feature", "f.value").agg(F.count("*").alias("n"), F.count_if(p).alias("tp"), F.count_if(~p).alias("fp")).withColumn("fp_per_tp", F.col("fp") / F.nullif(F.col("tp").cast("double"), F.lit(0.0)))


def numeric_summary(alerts: DataFrame, features: dict[str, Column]) -> DataFrame:
    """feature, means and linear quantiles of false and of true positives; null where there are none."""
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("double").alias("x")) for n, c in features.items()))
    fp, tp = F.when(F.expr("label = 0"), F.col("f.x")), F.when(F.expr(POSITIVE), F.col("f.x"))
    out = [F.avg(fp).alias("fp_mean"), F.avg(tp).alias("tp_mean"), *(F.percentile(fp, q).alias(f"fp_p{round(100 * q)}") for q in (0.5, 0.9)), *(F.percentile(tp, q).alias(f"tp_p{round(100 * q)}") for q in (0.5, 0.99))]
    return alerts.select("label", F.explode(rows).alias("f")).groupBy("f.feature").agg(*out)


def component_audit(scored: DataFrame, by: list[str], components: dict[str, Column], budgets: tuple[int, ...]) -> DataFrame:
    """by, component, gap of the means of positives and negatives, and true positives at each budget."""
    rows = F.array(*(F.struct(F.lit(n).alias("component"), c.alias("x")) for n, c in components.items()))
    long = scored.select(*by, "event_id", "label", F.explode(rows).alias("c")).select(*by, "event_id", "label", "c.*")
    p = F.expr(POSITIVE)
    gap = F.avg(F.when(p, F.col("x"))) - F.avg(F.when(~p, F.col("x")))
    return ranked(long, [*by, "component"], score="x", keep=("label",)).groupBy(*by, "component").agg(gap.alias("gap"), *(F.count_if((F.col("rk") <= b) & p).alias(f"tp_{b}") for b in budgets))


def alert_delay(scored: DataFrame, alerts: DataFrame, by: list[str]) -> DataFrame:
    """by, alerts on attacks from the first attack event on, false ones before it, and the delay in events; groups without an attack have no row."""
    first = scored.where("label = 2").groupBy(*by).agg(F.min("stream_pos").alias("first_pos"))
    late = F.when(F.expr("label = 2"), (F.col("stream_pos") - F.col("first_pos")).cast("double"))
    return alerts.join(first, by).groupBy(*by).agg(
        F.count_if(F.expr("label = 2 AND stream_pos >= first_pos")).alias("tp_after"), F.count_if(F.expr("label = 0 AND stream_pos < first_pos")).alias("fp_before"),
        F.avg(late).alias("mean_delay"), F.percentile(late, 0.5).alias("median_delay"), F.percentile(late, 0.9).alias("p90_delay"),
    )


def fp_per_day(scored: DataFrame, alerts: DataFrame, by: list[str]) -> DataFrame:
    """by, days on which there were events, fp, fp_per_day."""
    days = scored.groupBy(*by).agg(F.count_distinct(F.to_date("ts")).alias("days"))
    fp = alerts.where("label = 0").groupBy(*by).agg(F.count("*").alias("fp"))
    return days.join(fp, by, "left").withColumn("fp", F.coalesce("fp", F.lit(0))).withColumn("fp_per_day", F.col("fp") / F.col("days"))


def fbeta_search(scored: DataFrame, candidates: DataFrame, by: list[str], beta: float = 0.25) -> DataFrame:
    """by, q, thr, tp, fp, fn, fbeta of each candidate (by, q, thr) and its place; ties go to fewer false positives, then to the lower q."""
    p, over, b2 = F.expr(POSITIVE), F.col("score") >= F.col("thr"), beta * beta
    counts = candidates.join(scored, by).groupBy(*by, "q", "thr").agg(F.count_if(over & p).alias("tp"), F.count_if(over & ~p).alias("fp"), F.count_if(~over & p).alias("fn"))
    f = (1 + b2) * F.col("tp") / F.nullif((1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp"), F.lit(0.0))
    best = Window.partitionBy(*by).orderBy(F.col("fbeta").desc(), "fp", "q")  # a row for each candidate
    return counts.withColumn("fbeta", f).withColumn("choice", F.row_number().over(best))


def weight_grid(scored: DataFrame, by: list[str], weights: list[tuple[float, ...]], components: list[Column], budget: int) -> DataFrame:
    """by, weight_id, tp, fp among the ``budget`` highest weighted sums of components."""
    sums = []
    for i, w in enumerate(weights):
        x = F.lit(0.0)
        for a, c in zip(w, components):
            x = x + F.lit(float(a)) * c
        sums.append(F.struct(F.lit(i).alias("weight_id"), x.alias("x")))
    long = scored.select(*by, "event_id", "label", F.explode(F.array(*sums)).alias("w")).select(*by, "event_id", "label", "w.*")
    place = F.row_number().over(Window.partitionBy(*by, "weight_id").orderBy(F.col("x").desc(), "event_id"))  # kept up to the budget before the shuffle
    top = long.withColumn("rk", place).where(F.col("rk") <= budget)
    return top.groupBy(*by, "weight_id").agg(F.count_if(F.expr(POSITIVE)).alias("tp"), F.count_if(~F.expr(POSITIVE)).alias("fp"))


def prefix_sweep(alerts: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """by, k, n, tp, fp, sources among the first k alerts in the order of the stream."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("ts_us", "event_id"))
    first = alerts.withColumn("rk", place).where(F.col("rk") <= max(ks))
    return _at_ks(first, ks).groupBy(*by, "k").agg(F.count("*").alias("n"), F.count_if(F.expr(POSITIVE)).alias("tp"), F.count_if(F.expr("label = 0")).alias("fp"), F.count_distinct("info_src").alias("sources"))


def coverage_eval(touched: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: alerted nodes that are bad, not bad (strict), to be ignored because all their alerts are on attacks, or false; rates."""
    bad = truth.select("node_id").distinct().withColumn("bad", F.lit(True))
    nodes = touched.groupBy("host", "node_id").agg(F.bool_and(F.expr(POSITIVE)).alias("all_attack")).join(bad, "node_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    c = nodes.agg(F.count_if("bad").alias("tp"), F.count_if(F.expr("NOT bad")).alias("strict_fp"), F.count_if(F.expr("NOT bad AND all_attack")).alias("ignored"), F.count_if(F.expr("NOT bad AND NOT all_attack")).alias("fp"), F.count_distinct(F.when(F.col("bad"), F.col("node_id"))).alias("__found"))
    total = truth.agg(F.count("*").alias("__all"))
    share = lambda a, b: F.col(a) / F.nullif(b.cast("double"), F.lit(0.0))
    return c.join(F.broadcast(total)).select("tp", "strict_fp", "ignored", "fp", share("tp", F.col("tp") + F.col("strict_fp")).alias("strict_precision"), share("tp", F.col("tp") + F.col("fp")).alias("relaxed_precision"), share("__found", F.col("__all")).alias("recall"))


def label_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.stddev_samp("score").alias("std_score"))


def fp_groups(alerts: DataFrame, by: list[str]) -> DataFrame:
    """by, n, tp, fp, precision and the score's range and mean of alerts."""
    p = F.expr(POSITIVE)
    return alerts.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(p).alias("tp"), F.count_if(~p).alias("fp"), F.avg(p.cast("double")).alias("precision"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def node_fp_groups(touched: DataFrame, truth: DataFrame) -> DataFrame:
    """kind, bad, n_nodes, support, max_score of alerted nodes."""
    bad = truth.select("node_id").distinct().withColumn("bad", F.lit(1))
    nodes = touched.groupBy("host", "node_id").agg(F.max("kind").alias("kind"), F.count("*").alias("support"), F.max("score").alias("top")).join(bad, "node_id", "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
    return nodes.groupBy("kind", "bad").agg(F.count("*").alias("n_nodes"), F.sum("support").alias("support"), F.max("top").alias("max_score"))


def episode_metrics(alerts: DataFrame, truth: DataFrame, windows: DataFrame, by: list[str]) -> DataFrame:
    """by, alerts with a bad end, false ones, false ones outside all attack windows, and alerts in windows (once for each)."""
    bad = truth.select("node_id").distinct()
    rows = alerts
    for end in ("info_src", "info_dst"):
        rows = rows.join(bad.select(F.col("node_id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    rows = rows.join(F.broadcast(windows), F.col("ts").between(F.col("start_ts"), F.col("end_ts")), "left")
    c = lambda text: F.count_if(F.expr(text))
    return rows.groupBy(*by).agg(c("__info_src IS NOT NULL OR __info_dst IS NOT NULL").alias("any_endpoint_tp"), c("label = 0").alias("strict_fp"), c("label = 0 AND name IS NULL").alias("relaxed_fp"), c("name IS NOT NULL").alias("in_window"))


def score_drift(validation: DataFrame, scored: DataFrame, by: list[str], groups: list[str]) -> DataFrame:
    """groups, n, mean_drift: how many standard deviations of validation scores (by) the scores of a group lie over their mean."""
    v = validation.groupBy(*by).agg(F.avg("score").alias("__m"), F.stddev_pop("score").alias("__s"))
    return scored.join(v, by).groupBy(*groups).agg(F.count("*").alias("n"), F.avg((F.col("score") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))).alias("mean_drift"))


def case_losses(losses: DataFrame, cases: DataFrame) -> DataFrame:
    """target_case, n, mean_loss, max_loss of events with a loss."""
    rows = losses.join(cases.select("host", "event_id", "target_case"), ["host", "event_id"])
    return rows.groupBy("target_case").agg(F.count("*").alias("n"), F.avg("loss").alias("mean_loss"), F.max("loss").alias("max_loss"))
