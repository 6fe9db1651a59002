"""Thresholds, suppression by endpoint history, policies, update gates and their summaries. No label is read but in *_eval.

Scored events are rows of the flow with score; thresholds are rows of (group, n, thr, vmax). A group without a threshold gives
no alert. Tables of rules and thresholds have a row for each group of actions and kinds, so joins with them are left to the
planner, which sends them to all tasks while they are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.quantiles import quantile_higher, quantiles_higher

HISTORY_KEYS = {"n_src_endpoint_action": ["src", "endpoint", "action"], "n_src_endpoint": ["src", "endpoint"], "n_endpoint_action": ["endpoint", "action"]}


def group_quantile_thresholds(validation: DataFrame, by: list[str], q: float = 0.99) -> DataFrame:
    """by, n, thr (the quantile of validation scores, method higher), vmax."""
    return quantile_higher(validation, by, "score", q, "thr")


def with_threshold(scored: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    return scored.join(thresholds.select(*by, "thr"), by)


def alerts(scored: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Scored events at or over their group's threshold, with thr."""
    return with_threshold(scored, thresholds, by).where("score >= thr")


def score_summary(scored: DataFrame, by: list[str], qs: dict[str, float], thresholds: DataFrame | None = None) -> DataFrame:
    """by, n, moments and quantiles of scores, and how many are at or over their threshold."""
    over = [F.count_if(F.expr("score >= thr")).alias("n_over")] if thresholds is not None else []
    rows = with_threshold(scored, thresholds, by) if thresholds is not None else scored
    moments = rows.groupBy(*by).agg(F.min("score").alias("min_score"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.stddev_pop("score").alias("std_score"), *over)
    return quantiles_higher(scored, by, "score", qs).drop("vmax").join(moments, by)


def histogram_quantiles(scored: DataFrame, by: list[str], qs: dict[str, float], bins: int = 20_000) -> DataFrame:
    """by, total and quantiles as upper edges of equal bins between the group's least and greatest score, at most the greatest."""
    from pyspark.sql.window import Window

    span = scored.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo"))
    bin_ = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / width * bins).cast("int")))
    counts = scored.join(span, by).groupBy(*by, "lo", "hi", "total", bin_.alias("bin")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("bin"))  # at most ``bins`` rows a group
    edge = F.least(F.col("hi"), F.col("lo") + (F.col("bin") + 1) * width / bins)
    return counts.withColumn("upto", upto).groupBy(*by, "total").agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), edge)).alias(n) for n, q in qs.items()))


def budget_thresholds(validation: DataFrame, by: list[str], expected: float, horizon: float) -> DataFrame:
    """by, n, thr: the score that as many validation rows reach as alerts are expected, ``expected`` in ``horizon`` events (rounded half to even, 1 to n)."""
    from pyspark.sql.window import Window

    values = validation.groupBy(*by, "score").agg(F.count("*").alias("c"))
    n = values.groupBy(*by).agg(F.sum("c").alias("n"))
    # counts by distinct score; what is ordered is one row for each of them
    want = F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("n") * F.lit(expected) / F.lit(horizon)).cast("long")))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(F.col("score").desc()))
    return values.withColumn("upto", upto).join(n, by).groupBy(*by, "n").agg(F.max(F.when(F.col("upto") >= want, F.col("score"))).alias("thr"))


def tail_rate_thresholds(validation: DataFrame, by: list[str], expected: float, horizon: float) -> DataFrame:
    """by, thr_linear: the quantile, linear between scores, that leaves expected / horizon of validation scores above it (at most all)."""
    values = validation.groupBy(*by, "score").agg(F.count("*").alias("c"))
    return values.groupBy(*by).agg(F.percentile("score", max(0.0, min(1.0, 1.0 - expected / max(horizon, 1.0))), F.col("c")).alias("thr_linear"))


def history_counts(history: DataFrame, keys: list[str], out: str = "history_count") -> DataFrame:
    return history.groupBy(*keys).agg(F.count("*").alias(out))


def with_history(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Adds how often earlier events had the same source, endpoint and action, or two of them; 0 if never."""
    out = candidates
    for name, keys in HISTORY_KEYS.items():
        out = out.join(history_counts(history, keys, name), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def suppressed(candidates: DataFrame, history: DataFrame, thresholds: DataFrame, by: list[str], least: int = 5, margin: float = 0.25) -> DataFrame:
    """Adds thr, is_alert, history_count, is_suppressed and match_level: an alert of a known pair that is less than ``margin`` over its threshold is suppressed."""
    keys = HISTORY_KEYS["n_src_endpoint_action"]
    known = history_counts(history, keys)
    rows = with_threshold(candidates, thresholds, by).join(known, keys, "left").withColumn("history_count", F.coalesce("history_count", F.lit(0))).withColumn("is_alert", F.expr("score >= thr"))
    match = F.col("history_count") >= least
    return rows.withColumn("is_suppressed", F.col("is_alert") & match & (F.col("score") < F.col("thr") + margin)).withColumn("match_level", F.when(match, "src_endpoint_action").otherwise("none"))


def suppression_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("is_alert").alias("raw_alerts"), F.count_if("is_suppressed").alias("suppressed"), F.count_if(F.expr("is_alert AND NOT is_suppressed")).alias("final_alerts"),
        F.max("score").alias("max_score"), F.avg("score").alias("mean_score"),
    )


def suppression_eval(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, true and false alerts before and after suppression, and suppressed true ones (rows with label)."""
    c = lambda text: F.count_if(F.expr(text))
    return rows.groupBy(*by).agg(
        c("is_alert AND label > 0").alias("tp_before"), c("is_alert AND label = 0").alias("fp_before"), c("is_alert AND NOT is_suppressed AND label > 0").alias("tp_after"),
        c("is_alert AND NOT is_suppressed AND label = 0").alias("fp_after"), c("is_suppressed AND label > 0").alias("tp_suppressed"),
    )


# Priorities of decisions.
PRIORITIES = {"high": "high", "alert": "default", "evidence": "low"}


def decided(rows: DataFrame, rules: DataFrame, defaults: DataFrame, alert: str = "TRUE") -> DataFrame:
    """Each row once for each policy, with its decision, priority and whether it is final.

    The decision is the rule's for (action, src_kind, dst_kind), else the policy's default; rows for which ``alert`` doesn't hold are
    ``not_alert``, without a priority, and not final. Evidence isn't final either.
    """
    keys = ["policy", "action", "src_kind", "dst_kind"]
    each = rows.join(F.broadcast(defaults.select("policy", F.col("decision").alias("__default"))))  # a row for each policy
    ruled = each.join(rules.select(*keys, "decision"), keys, "left")
    over = F.coalesce(F.expr(alert), F.lit(False))
    decision = F.when(over, F.coalesce("decision", "__default")).otherwise("not_alert")
    priority = F.create_map(*(F.lit(x) for kv in PRIORITIES.items() for x in kv))
    return ruled.withColumn("decision", decision).drop("__default").withColumns({"priority": F.coalesce(priority[F.col("decision")], F.lit("")), "is_final": ~F.col("decision").isin("evidence", "not_alert")})


def update_gate(scored: DataFrame, thresholds: DataFrame, by: list[str], rate: float, least: float = 0.05) -> DataFrame:
    """Adds q: 1 up to the threshold, then falling exponentially with the excess, at least ``least``."""
    rows = with_threshold(scored, thresholds, by)
    return rows.withColumn("q", F.when(F.expr("score <= thr"), F.lit(1.0)).otherwise(F.greatest(F.lit(least), F.exp(-(F.col("score") - F.col("thr")) * rate))))


def gate_stats(gated: DataFrame, by: list[str]) -> DataFrame:
    return gated.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("q").alias("mean_q"), F.min("q").alias("min_q"), F.max("q").alias("max_q"), F.coalesce(F.stddev_pop("q"), F.lit(0.0)).alias("std_q"),
        F.count_if(F.expr("q = 1.0")).alias("applied"), F.count_if(F.expr("q < 1.0")).alias("reduced"),
    )


def group_score_summary(validation: DataFrame, scored: DataFrame, by: list[str], q: float = 0.99) -> DataFrame:
    """by, val_n, val_q of validation, and test_n, alerts, hits, precision and recall share of scored events with thr and label; a group may lack either half."""
    v = quantiles_higher(validation, by, "score", {"val_q": q}).drop("vmax").withColumnRenamed("n", "val_n")
    c = lambda text: F.count_if(F.expr(text))
    t = scored.groupBy(*by).agg(F.count("*").alias("test_n"), c("score >= thr").alias("n_alerts"), c("score >= thr AND label > 0").alias("tp"), c("score >= thr AND label = 0").alias("fp"), c("label > 0").alias("__p"))
    share = lambda b: F.col("tp") / F.nullif(F.col(b).cast("double"), F.lit(0.0))
    return v.join(t, by, "full_outer").withColumns({"precision": share("n_alerts"), "recall_share": share("__p")}).drop("__p")


def threshold_sweep(validation: DataFrame, scored: DataFrame, by: list[str], qs: list[float], margins: list[float]) -> DataFrame:
    """q, margin and the events and actors that each pair of them would have alerted on, true and false (scored has label)."""
    names = {f"q{i}": q for i, q in enumerate(qs)}
    fitted = quantiles_higher(validation, by, "score", names)
    grid = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.lit(float(m)).alias("margin"), (F.col(n) + m).alias("thr")) for n, q in names.items() for m in margins))
    over = scored.join(fitted.select(*by, F.explode(grid).alias("g")), by).where("score >= g.thr")
    p = F.expr("label > 0")
    return over.groupBy("g.q", "g.margin").agg(F.count_if(p).alias("tp"), F.count_if(~p).alias("fp"), F.count_distinct(F.when(p, F.col("actor_id"))).alias("tp_actors"), F.count_distinct(F.when(~p, F.col("actor_id"))).alias("fp_actors"))


def alert_touches(alert_rows: DataFrame) -> DataFrame:
    """A row for each alert and node it covers."""
    loop = F.col("info_src") == F.col("info_dst")
    ends = F.filter(F.array(F.struct(F.col("info_src").alias("node_id"), F.col("src_kind").alias("kind"), F.lit(1).alias("as_src"), loop.cast("int").alias("as_dst")),
                            F.when(~loop, F.struct(F.col("info_dst").alias("node_id"), F.col("dst_kind").alias("kind"), F.lit(0).alias("as_src"), F.lit(1).alias("as_dst")))), lambda x: x.isNotNull())
    return alert_rows.withColumn("e", F.explode(ends)).select(*alert_rows.columns, "e.*")


def robust_stats(scored: DataFrame, by: list[str], qs: dict[str, float], floor: float = 1e-6) -> DataFrame:
    """by, median, mad (median absolute deviation and a floor) and quantiles, linear between scores.

    Scores are counted by value first, so that each group's percentiles gather distinct values with weights.
    """
    values = scored.groupBy(*by, "score").agg(F.count("*").alias("c"))
    first = values.groupBy(*by).agg(F.percentile("score", 0.5, F.col("c")).alias("median"), *(F.percentile("score", q, F.col("c")).alias(n) for n, q in qs.items()))
    spread = values.join(first.select(*by, "median"), by).groupBy(*by).agg((F.percentile(F.abs(F.col("score") - F.col("median")), 0.5, F.col("c")) + floor).alias("mad"))
    return first.join(spread, by)


def upper_z(scored: DataFrame, stats: DataFrame, by: list[str], most: float = 20.0) -> DataFrame:
    """Adds z, how many robust deviations a score lies over the median: 0 below it, at most ``most``."""
    z = (F.col("score") - F.col("median")) / (1.4826 * F.col("mad"))
    return scored.join(stats.select(*by, "median", "mad"), by).withColumn("z", F.least(F.lit(most), F.greatest(z, F.lit(0.0))))


def quantile_knots(scored: DataFrame, by: list[str], qs: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)) -> DataFrame:
    """by, q, knot, surprise (-log10 of the tail): quantiles of scores, of equal ones only the first."""
    fitted = quantiles_higher(scored, by, "score", {f"q{i}": q for i, q in enumerate(qs)})
    rows = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.col(f"q{i}").alias("knot"), (F.lit(None).cast("double") if i == 0 else F.col(f"q{i - 1}")).alias("before")) for i, q in enumerate(qs)))
    long = fitted.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    return long.where("before IS NULL OR knot > before").select(*by, "q", "knot", (-F.log10(1 - F.col("q"))).alias("surprise"))
