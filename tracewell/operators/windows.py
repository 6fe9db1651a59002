"""What a node or an edge has seen before: windows by key in the order of the stream. Keys are nodes or edges of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tracewell.operators.flow import order
from tracewell.operators.prefix import partitions
from tracewell.sources.staging import stage


def keyed(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order())


def edge_novelty(flow: DataFrame, family: Column) -> DataFrame:
    """Adds excess: by how much an event with thr exceeds it, if its edge (host, ends, family) is new; else 0."""
    first = F.row_number().over(Window.partitionBy("host", "info_src", "info_dst", family).orderBy(*order())) == 1
    return flow.withColumn("excess", F.when(first, F.greatest(F.col("score") - F.col("thr"), F.lit(0.0))).otherwise(F.lit(0.0)))


def recent(touched: DataFrame, seconds: float) -> DataFrame:
    """host, node_id, stream_pos, event_id, recent_peers (before the event), kinds, actions and transitions (with it): distinct ones within the last ``seconds`` at the node.

    A sweep, linear in the touches. What a touch shows (a peer, say) counts from it until the next touch that shows the same, or
    until ``seconds`` have passed. So it adds 1 unless the one before is still counted, and 1 is taken off at the end of its time
    unless the next has come by then; distinct counts are running sums over touches and ends. Rows are dealt to nodes once, narrow:
    neighbours that show the same, and the sums, are found where the node's touches already are. A touch has one end for all that it shows.
    """
    span = round(seconds * 1e6)
    shown = {"recent_peers": ["peer"], "kinds": ["peer_kind"], "actions": ["action"], "transitions": ["kind", "action", "peer_kind"]}
    parts = partitions(touched)
    rows = touched.select("host", "node_id", "stream_pos", "event_id", "ts_us", "peer", "kind", "peer_kind", "action").repartition(parts, "host", "node_id")
    for name, what in shown.items():
        same = Window.partitionBy("host", "node_id", *what).orderBy("stream_pos")
        starts = F.coalesce(F.col("ts_us") - F.lag("ts_us").over(same) > span, F.lit(True))
        ends = F.coalesce(F.lead("ts_us").over(same) - F.col("ts_us") > span, F.lit(True))
        rows = rows.withColumns({f"__start_{name}": starts.cast("int"), f"__end_{name}": ends.cast("int")})
    by = lambda sign, end: [(sign * F.col(f"__{end}_{name}")).alias(name) for name in shown]
    ended = F.greatest(*(F.col(f"__end_{name}") for name in shown)) > 0
    change = F.filter(
        F.array(
            F.struct(F.lit(0).alias("phase"), F.col("ts_us").alias("at"), *by(1, "start")),
            # the end comes after all touches of its instant
            F.when(ended, F.struct(F.lit(1).alias("phase"), (F.col("ts_us") + span).alias("at"), *by(-1, "end"))),
        ),
        lambda x: x.isNotNull(),
    )
    marks = rows.select("host", "node_id", "stream_pos", "event_id", F.explode(change).alias("c")).select("host", "node_id", "stream_pos", "event_id", "c.*")
    upto = Window.partitionBy("host", "node_id").orderBy("at", "phase", "stream_pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(name).over(upto).alias(name) for name in shown if name != "recent_peers"]
    peers = (F.sum("recent_peers").over(upto) - F.col("recent_peers")).alias("recent_peers")
    return marks.select("host", "node_id", "stream_pos", "event_id", "phase", peers, *sums).where("phase = 0").drop("phase")


_TERMS = {"pair": ["info_src", "info_dst"], "edge": ["info_src", "info_dst", "role"], "role": ["role"]}
#: tables up to so many rows are sent to all tasks: roles, and transitions (two whole numbers each)
FEW_ROLES, FEW_TRANSITIONS = 10_000, 400_000


def chain_profile(flow: DataFrame, train: str, wanted: str, slots: int = 4, most_gap: int = 24, association: float = 0.35, smoothing: int = 100) -> DataFrame:
    """host, event_id, rarities of the event and of how its ends came to it, and the scores made of them; for wanted events.

    An event's role is its action and its ends' kinds; its pair is both ends, its edge role and pair. A transition leads
    from one of the last ``slots`` roles at the source or destination to this one: side, both roles, slot (3 at most) and the gap
    in time, floor(log2(seconds + 1)), ``most_gap`` at most. A loop is one event in its node's past and a transition on
    both sides. Rarity is -ln((n + 1) / (all + smoothing)) by counts of training events, or of their transitions. The
    score is 0.2 pair + 0.1 edge + 0.1 role + 0.6 of the rarest transition, blended with the association score by ``association``: 0.7
    discrepancy (the rarest transition less half of what role or edge explain, 0 at least), 0.2 of the mean transition, 0.1 pair.
    Without a transition it is 0.45 pair + 0.15 edge + 0.4 role.
    """
    role = F.concat_ws("|", "action", "src_kind", "dst_kind")
    named = stage(flow.select("host", "event_id", "ts_us", "split", "info_src", "info_dst", role.alias("name")), "chain-events")
    # as many rows as there are combinations of action and kinds
    roles = stage(named.select("name").distinct().withColumn("role", F.row_number().over(Window.orderBy("name")).cast("long") - 1), "roles")
    n_roles = roles.count()
    events = named.join(F.broadcast(roles) if n_roles <= FEW_ROLES else roles, "name").drop("name")
    loop = F.col("info_src") == F.col("info_dst")
    ends = F.array(F.struct(F.col("info_src").alias("node_id"), F.lit(0).cast("long").alias("side")), F.when(~loop, F.struct(F.col("info_dst").alias("node_id"), F.lit(1).cast("long").alias("side"))))
    at_nodes = events.select("host", "event_id", "ts_us", "split", "role", loop.alias("loop"), F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("e")).select("*", "e.*").drop("e")
    past = keyed("host", "node_id")
    came = at_nodes.withColumns({f"{c}_{k}": F.lag(of, k).over(past) for k in range(1, slots + 1) for c, of in (("role", "role"), ("us", "ts_us"))}).where("role_1 IS NOT NULL")
    gap = lambda k: F.least(F.length(F.bin(F.floor((F.col("ts_us") - F.col(f"us_{k}")) / 1e6).cast("long") + 1)) - 1, F.lit(most_gap))  # noqa: E731 - floor of the logarithm by whole numbers
    # a number for side, both roles, gap and slot; null where the node has no role so long ago
    key = lambda side, k: (((side * n_roles + F.col(f"role_{k}")) * n_roles + F.col("role")) * (most_gap + 1) + gap(k)) * 4 + min(k - 1, 3)
    keys = lambda side: F.array(*(key(side, k) for k in range(1, slots + 1)))
    both = F.when(F.col("loop"), F.concat(keys(F.lit(0).cast("long")), keys(F.lit(1).cast("long")))).otherwise(keys(F.col("side")))
    is_train, is_wanted = F.expr(train), F.expr(wanted)
    # nodes are ordered once, for what is counted and what is scored
    steps = came.where(is_train | is_wanted).select(is_train.alias("train"), is_wanted.alias("wanted"), *(F.when(is_wanted, F.col(c)).alias(c) for c in ("host", "event_id")), both.alias("keys"))
    steps = stage(steps, "steps")
    rarity = lambda n, total: -F.log((F.coalesce(n, F.lit(0)) + 1.0) / (F.coalesce(total, F.lit(0)) + smoothing))
    known = stage(steps.where("train").select(F.explode("keys").alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")), "transitions")
    # totals are one row each
    total = known.agg(F.sum("n").alias("total"))
    seen = F.broadcast(known) if known.count() <= FEW_TRANSITIONS else known
    found = steps.where("wanted").select("host", "event_id", F.explode("keys").alias("key")).where("key IS NOT NULL").join(seen, "key", "left").join(F.broadcast(total)).groupBy("host", "event_id").agg(
        F.max(rarity(F.col("n"), F.col("total"))).alias("transition"), F.avg(rarity(F.col("n"), F.col("total"))).alias("transition_mean")
    )
    rows = events.where(wanted)
    trained = events.where(train)
    n_trained = trained.agg(F.count("*").alias("trained"))
    for name, of in _TERMS.items():
        rows = rows.join(trained.groupBy(*of).agg(F.count("*").alias(f"n_{name}")), of, "left")
    rows = rows.join(F.broadcast(n_trained)).join(found, ["host", "event_id"], "left")
    rows = rows.withColumns({f"{name}_rarity": rarity(F.col(f"n_{name}"), F.col("trained")) for name in _TERMS})
    p, e, r, t = (F.col(c) for c in ("pair_rarity", "edge_rarity", "role_rarity", "transition"))
    discrepancy = F.coalesce(F.greatest(t - 0.5 * F.greatest(r, e), F.lit(0.0)), F.lit(0.0))
    linked = 0.7 * discrepancy + 0.2 * F.col("transition_mean") + 0.1 * p
    blended = (1 - association) * (0.2 * p + 0.1 * e + 0.1 * r + 0.6 * t) + association * linked
    score = F.when(t.isNotNull(), blended).otherwise(0.45 * p + 0.15 * e + 0.4 * r)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "host", "event_id", "pair_rarity", "edge_rarity", "role_rarity", zero(t).alias("max_rarity"), zero(F.col("transition_mean")).alias("mean_rarity"), discrepancy.alias("discrepancy"), score.alias("chain_score")
    )


def time_gaps(placed: DataFrame) -> DataFrame:
    """host, event_id and ln(1 + seconds) since the last event of the host, of the source and of the edge; 0 without one.

    The host's last event is found by its number, not by ordering the host in one task.
    """
    gap = lambda us: F.coalesce(F.log(1 + (F.col("ts_us") - us) / 1000000.0), F.lit(0.0))
    last = placed.select("host", (F.col("stream_pos") + 1).alias("stream_pos"), F.col("ts_us").alias("__last"))
    own = placed.withColumns({"src_gap": gap(F.lag("ts_us").over(keyed("host", "info_src"))), "edge_gap": gap(F.lag("ts_us").over(keyed("host", "info_src", "info_dst")))})
    return own.join(last, ["host", "stream_pos"], "left").withColumn("global_gap", gap(F.col("__last"))).select("host", "event_id", "global_gap", "src_gap", "edge_gap")


def decayed_max(touched: DataFrame, tau_seconds: float, origin_us: int) -> DataFrame:
    """Adds decayed, the greatest earlier or own score at the node, falling by e each ``tau_seconds``: a running maximum of logarithms."""
    age = (F.col("ts_us") - origin_us) / (tau_seconds * 1e6)
    return touched.where("score > 0").withColumn("decayed", F.exp(F.max(F.log("score") + age).over(keyed("host", "node_id")) - age))


def state_asof(touched: DataFrame) -> DataFrame:
    """Adds last_score (0 without) and last_us of the node strictly before the event."""
    at = keyed("host", "node_id")
    return touched.withColumns({"last_score": F.coalesce(F.lag("score").over(at), F.lit(0.0)), "last_us": F.lag("ts_us").over(at)})


def pool_checkpoints(touched: DataFrame, every: int) -> DataFrame:
    """host, checkpoint, best_score, best_node, active_nodes: the largest running sum of scores among a host's nodes in each ``every`` events; of equal sums the larger id."""
    pool = F.sum("score").over(keyed("host", "node_id"))
    rows = touched.withColumn("pool", pool).withColumn("checkpoint", F.floor(F.col("stream_pos") / every).cast("long"))
    best = F.max(F.struct("pool", "node_id"))
    return rows.groupBy("host", "checkpoint").agg(best["pool"].alias("best_score"), best["node_id"].alias("best_node"), F.count_distinct("node_id").alias("active_nodes"))


def top_per_node(touched: DataFrame, m: int) -> DataFrame:
    """The m best scores of each node, with their place."""
    return touched.withColumn("r", F.row_number().over(Window.partitionBy("host", "node_id").orderBy(F.col("score").desc(), *order()))).where(F.col("r") <= m)


# What each node-pool score adds to the mass of the best scores (logarithms of 1 + ...).
POOL_FORMULAS = {
    "base": (), "base_conf": (), "base_conf_repeat": ("repeats",), "base_conf_chain": ("chains",), "base_conf_residual": ("residual_mass",), "base_conf_repeat_chain": ("repeats", "chains"),
    "base_conf_residual_repeat_chain": ("residual_mass", "repeats", "chains"), "pool_base": (), "pool_base_adaptive": ("residual_mass",), "pool_base_assoc": ("action_peers",), "pool_base_chain": ("chains",),
    "pool_base_adaptive_assoc_chain": ("residual_mass", "action_peers", "chains"),
}


def best_sum(touched: DataFrame, value: str, m: int, out: str) -> DataFrame:
    """host, node_id and the sum of a node's m largest values; a hub's rows are cut to these before they meet in one task."""
    place = F.row_number().over(Window.partitionBy("host", "node_id").orderBy(F.col(value).desc(), *order()))
    return touched.withColumn("r", place).where(F.col("r") <= m).groupBy("host", "node_id").agg(F.sum(value).alias(out))


def node_pool(touched: DataFrame, m: int = 32, residual: str = "residual", formulas: dict[str, tuple[str, ...]] = POOL_FORMULAS) -> DataFrame:
    """host, node_id, n, chains (distinct pairs), action_peers, mass and residual_mass (sums of the m largest), and a score for each formula."""
    counts = touched.groupBy("host", "node_id").agg(F.count("*").alias("n"), F.count_distinct("as_src", "peer").alias("chains"), F.count_distinct("action", "peer").alias("action_peers"))
    rows = counts.join(best_sum(touched, "score", m, "mass"), ["host", "node_id"]).join(best_sum(touched, residual, m, "residual_mass"), ["host", "node_id"])
    terms = {"repeats": F.col("n") / F.col("chains"), **{c: F.col(c) for c in ("chains", "action_peers", "residual_mass")}}
    return rows.withColumns({name: sum((F.log1p(terms[t]) for t in parts), F.col("mass")) for name, parts in formulas.items()})
