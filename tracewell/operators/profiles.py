"""Counts of what training data held, and how rare an event is by them.

Flows have info_src, info_dst, action, src_kind, dst_kind, split; touches are a row for each event and node. Count tables grow with
distinct keys and are joined by key; only totals (one row) are broadcast. Rarities are -ln of smoothed shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators.prefix import numbered

#: the commonest tokens that a vocabulary keeps, beside the unknown one
VOCABULARY = 8192


def counts(df: DataFrame, keys: list[str], out: str = "c") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def with_count(df: DataFrame, table: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds the count of the row's key in a count table, null if it was never seen."""
    return df.join(table.select(*keys, F.col(table.columns[-1]).alias(out)), keys, "left")


def with_total(df: DataFrame, rows: DataFrame, out: str = "total") -> DataFrame:
    return df.join(F.broadcast(rows.agg(F.count("*").alias(out))))  # one row


def nll(seen: str | Column, total: Column, seen_more: float = 1.0) -> Column:
    return -F.log((F.coalesce(F.col(seen) if isinstance(seen, str) else seen, F.lit(0)) + F.lit(seen_more)) / total)


def split_overlap(touched: DataFrame, state_bytes: int = 256) -> DataFrame:
    """One row: nodes by the splits in which they occur."""
    there = lambda s: F.max((F.col("split") == s).cast("int"))
    n = touched.groupBy("node_id").agg(there("train").alias("a"), there("validation").alias("b"), there("test").alias("c"))
    c = lambda text: F.count_if(F.expr(text))
    return n.agg(
        F.count("*").alias("n_nodes"), c("a = 1").alias("in_train"), c("b = 1").alias("in_validation"), c("c = 1").alias("in_test"), c("a + b = 2").alias("train_validation"), c("a + c = 2").alias("train_test"),
        c("b + c = 2").alias("validation_test"), c("a + b + c = 3").alias("in_all"), c("c = 1 AND a + b = 0").alias("test_only"), (F.count("*") * state_bytes).alias("state_bytes"),
    )


def node_mixing(touched: DataFrame) -> DataFrame:
    """host, node_id, n_events, neighbours, action_entropy in bits, collision (several kinds under one id)."""
    per_action = counts(touched, ["host", "node_id", "action"])
    # the entropy from sums over actions: log n - (sum c log c) / n
    n = F.sum("c")
    entropy = F.abs(F.log2(n.cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / n)
    seen = touched.groupBy("host", "node_id").agg(F.count_distinct("peer").alias("neighbours"), (F.count_distinct("kind") > 1).alias("collision"))
    return per_action.groupBy("host", "node_id").agg(n.alias("n_events"), entropy.alias("action_entropy")).join(seen, ["host", "node_id"])


def nearest_rank_summary(touched: DataFrame, by: list[str], qs: dict[str, float], low: int = 3) -> DataFrame:
    """by, n_nodes, quantiles of nodes' touches (nearest rank, rounded half to even), share of nodes with fewer than ``low``."""
    n = counts(touched, [*by, "node_id"], "n")
    # nodes are counted by their number of touches, which is what is ordered
    by_n = n.groupBy(*by, "n").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("n"))
    m = by_n.groupBy(*by).agg(F.sum("c").alias("n_nodes"), (F.sum(F.when(F.col("n") < low, F.col("c")).otherwise(0)) / F.sum("c")).alias("low_support"))
    at = lambda q: F.bround(F.lit(q) * (F.col("n_nodes") - 1))
    return by_n.withColumn("upto", upto).join(m, by).groupBy(*by, "n_nodes", "low_support").agg(*(F.min(F.when(F.col("upto") - 1 >= at(q), F.col("n"))).alias(k) for k, q in qs.items()))


def node_tokens(words: DataFrame) -> DataFrame:
    """A row for each node and token of its words; nodes without words have the token ``unknown``."""
    said = F.coalesce(F.nullif(F.col("tokens"), F.lit("")), F.lit("unknown"))
    return words.select("node_id", "kind", F.explode(F.split(said, " ")).alias("token")).where("token <> ''")


def event_tokens(flow: DataFrame, tokens: DataFrame) -> DataFrame:
    """A row for each event and token at either end."""
    ends = flow.select("host", "split", "event_id", F.explode(F.array("info_src", "info_dst")).alias("node_id"))
    return ends.join(tokens.select("node_id", "token"), "node_id")


def vocabulary(train_tokens: DataFrame) -> DataFrame:
    """token, n, place: the commonest first, then by the alphabet; ranked over range partitions."""
    return numbered(counts(train_tokens, ["token"], "n"), [], [F.col("n").desc(), F.col("token")], "place")


def frozen(train_tokens: DataFrame, most: int = VOCABULARY, least: int = 5) -> DataFrame:
    """token, n, token_id: 0 (unknown) for tokens seen under ``least`` times or beyond the ``most`` - 1 commonest."""
    kept = (F.col("n") >= least) & (F.col("place") < most)
    return vocabulary(train_tokens).select("token", "n", F.when(kept, F.col("place")).otherwise(0).alias("token_id"))


def unknown_rates(tokens: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    ids = known.where("token_id > 0").select("token", "token_id")
    unknown = F.col("token_id").isNull()
    return tokens.join(ids, "token", "left").groupBy(*by).agg(F.count("*").alias("n"), F.count_if(unknown).alias("n_unknown"), F.avg(unknown.cast("double")).alias("unknown_rate"))


def token_coverage(touched: DataFrame, tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """split, nodes, tokens, oov_tokens, nodes with only unknown tokens, and with some."""
    seen = touched.select("split", "node_id").distinct().join(tokens.select("node_id", "token"), "node_id").join(vocab.select("token", F.lit(0).alias("known")), "token", "left")
    per = seen.groupBy("split", "node_id").agg(F.count("*").alias("k"), F.count_if(F.col("known").isNull()).alias("o"))
    return per.groupBy("split").agg(F.count("*").alias("nodes"), F.sum("k").alias("tokens"), F.sum("o").alias("oov_tokens"), F.count_if(F.expr("o = k")).alias("all_oov"), F.count_if(F.expr("o > 0 AND o < k")).alias("partial_oov"))


def conditional_nll(train: DataFrame, wanted: DataFrame, n_actions: int = 10, n_kinds: int = 3) -> DataFrame:
    """host, event_id, action_nll (given the source's kind) and dst_kind_nll (given source kind and action, or alone where that pair is new)."""
    rows = with_total(wanted, train)
    for keys, out in ((["src_kind", "action"], "a"), (["src_kind"], "s"), (["src_kind", "action", "dst_kind"], "d"), (["dst_kind"], "g")):
        rows = with_count(rows, counts(train, keys), keys, out)
    known = lambda c: F.coalesce(F.col(c), F.lit(0))
    backed = F.when(F.col("a").isNull(), nll("g", F.col("total") + float(n_kinds))).otherwise(nll("d", F.col("a") + float(n_kinds)))
    return rows.select("host", "event_id", nll("a", known("s") + float(n_actions)).alias("action_nll"), backed.alias("dst_kind_nll"))


def field_nll(train: DataFrame, wanted: DataFrame, tokens: DataFrame, worst: float = 20.0, unseen_weight: float = 1.5) -> DataFrame:
    """host, event_id, dst_field_nll (mean over the destination's tokens, and a weight for unseen ones) and worst, given the action."""
    said = tokens.select(F.col("node_id").alias("info_dst"), "token")
    seen = train.join(said, "info_dst")
    pair = counts(seen, ["action", "token"])
    context = seen.groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("token").alias("v"))
    rows = with_count(wanted.join(said, "info_dst").join(context, "action"), pair, ["action", "token"], "c")
    x = F.least(F.lit(worst), nll("c", F.col("n") + F.col("v")))
    return rows.groupBy("host", "event_id").agg((F.avg(x) + unseen_weight * F.avg(F.col("c").isNull().cast("double"))).alias("dst_field_nll"), F.max(x).alias("worst"))


def edge_surprise(train: DataFrame, wanted: DataFrame) -> DataFrame:
    """host, event_id, surprise: how much rarer an edge is than all events, counting earlier wanted events of the edge in its host."""
    keys = ["info_src", "info_dst", "action"]
    online = F.row_number().over(Window.partitionBy("host", *keys).orderBy("ts_us", "event_id")) - 1
    rows = with_total(with_count(wanted.withColumn("online", online), counts(train, keys), keys, "c"), train)
    return rows.select("host", "event_id", F.greatest(F.log(1.0 + F.col("total")) - F.log(1.0 + F.coalesce("c", F.lit(0)) + F.col("online")), F.lit(0.0)).alias("surprise"))


def token_rarity(train_tokens: DataFrame, wanted_tokens: DataFrame, top: int = 3) -> DataFrame:
    """host, event_id, mean, maximum and mean of the ``top`` rarest of an event's tokens, and how many were unseen."""
    vocab = counts(train_tokens, ["token"])
    rows = with_total(with_total(with_count(wanted_tokens, vocab, ["token"], "c"), train_tokens), vocab, "kinds")
    each = rows.select("host", "event_id", nll("c", F.col("total") + F.col("kinds")).alias("x"), F.col("c").isNull().cast("long").alias("new"))
    sorted_ = F.sort_array(F.collect_list("x"), False)  # the tokens of one event
    first = F.slice(sorted_, 1, top)
    mean = F.aggregate(first, F.lit(0.0), lambda a, x: a + x) / F.size(first)
    return each.groupBy("host", "event_id").agg(F.avg("x").alias("mean_rarity"), F.max("x").alias("max_rarity"), mean.alias("top3_rarity"), F.sum("new").alias("unseen"))


PROFILES = {"edge_rarity": ["info_src", "info_dst"], "src_rarity": ["info_src"], "dst_rarity": ["info_dst"], "relation_rarity": ["action", "dst_kind"]}


def profile_rarity(train: DataFrame, wanted: DataFrame, profiles: dict[str, list[str]] = PROFILES) -> DataFrame:
    """host, event_id, a rarity for each profile, and of the ends by themselves: how rarely a node was an end at all, and the rarer of both."""
    rows = with_total(wanted, train)
    for out, keys in profiles.items():
        rows = with_count(rows, counts(train, keys), keys, f"__{out}")
    own = train.select(F.explode(F.array("info_src", "info_dst")).alias("node")).groupBy("node").agg(F.count("*").alias("c"))
    for end in ("src", "dst"):
        rows = rows.join(own.select(F.col("node").alias(f"info_{end}"), F.col("c").alias(f"__{end}_self")), f"info_{end}", "left")
    selves = {f"{end}_self_rarity": -F.log((F.coalesce(f"__{end}_self", F.lit(0)) + 1.0) / (2 * F.col("total") + 1.0)) for end in ("src", "dst")}
    rarities = [nll(f"__{out}", F.col("total") + 1.0).alias(out) for out in profiles]
    return rows.select("host", "event_id", *rarities, *(c.alias(n) for n, c in selves.items()), F.greatest(*selves.values()).alias("endpoint_self_rarity"))


def temporal_count_score(train: DataFrame, wanted: DataFrame, n_actions: int = 10) -> DataFrame:
    """host, event_id, score (action and edge rarity together) and which of them is larger."""
    rows = with_total(wanted, train)
    for keys, out in ((["src_kind", "action"], "a"), (["src_kind"], "s"), (["info_src", "info_dst"], "e")):
        rows = with_count(rows, counts(train, keys), keys, out)
    action = nll("a", F.coalesce("s", F.lit(0)) + float(n_actions))
    edge = F.log(1.0 + F.col("total")) - F.log(1.0 + F.coalesce("e", F.lit(0)))
    return rows.select("host", "event_id", (action + edge).alias("score"), F.when(action >= edge, "action").otherwise("edge").alias("top_component"))


def role_audit(flow: DataFrame, words: DataFrame, top: int = 20) -> DataFrame:
    """split, events, unknown, roles, and the ``top`` commonest words of actors with their place and number."""
    said = flow.join(words.select(F.col("node_id").alias("actor_id"), "tokens"), "actor_id")
    per = counts(said, ["split", "tokens"], "n")
    best = per.withColumn("r", F.row_number().over(Window.partitionBy("split").orderBy(F.col("n").desc(), "tokens"))).where(F.col("r") <= top)
    totals = per.groupBy("split").agg(F.sum("n").alias("events"), F.coalesce(F.sum(F.when(F.col("tokens") == "unknown", F.col("n"))), F.lit(0)).alias("unknown"), F.count("tokens").alias("roles"))
    return best.join(totals, "split").select("split", "events", "unknown", "roles", "r", "tokens", "n")


def collisions(nodes: DataFrame, words: DataFrame, train_touched: DataFrame) -> DataFrame:
    """tokens, raw_values, nodes and references in training of all nodes that share them."""
    refs = counts(train_touched, ["node_id"])
    raw = nodes.select("node_id", F.coalesce("path", "dst_addr").alias("raw")).join(refs, "node_id", "left")
    return words.select("node_id", "tokens").join(raw, "node_id").groupBy("tokens").agg(F.count_distinct("raw").alias("raw_values"), F.count_distinct("node_id").alias("nodes"), F.coalesce(F.sum("c"), F.lit(0)).alias("train_refs"))


def latent_dimensions(vocab: DataFrame, steps=((100, 32), (1000, 64), (10000, 128)), otherwise: int = 256) -> DataFrame:
    """One row: the size of a vocabulary and of the vectors that suit it."""
    dim = F.lit(otherwise)
    for most, d in reversed(steps):
        dim = F.when(F.col("n") < most, d).otherwise(dim)
    return vocab.agg(F.count("*").alias("n")).withColumn("latent_dim", dim)
