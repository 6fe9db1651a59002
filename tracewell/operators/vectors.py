"""Distances, residuals and targets of pairs of vectors, by array functions: nothing is exploded but to sum over many vectors.

Pairs have p and y, arrays of double of one length, and label (the group whose variance calibrates them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-8


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: str, b: str) -> Column:
    return 1 - dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(FLOOR))


def squares(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y) * (x - y))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mse(a: str, b: str) -> Column:
    return total(squares(a, b)) / F.size(a)


def paired(vectors: DataFrame, partner: Column) -> DataFrame:
    """vec_id, label, p and y: each vector and that of its partner, met once by id."""
    own = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("p")).withColumn("__with", partner)
    return own.join(vectors.select(F.col("vec_id").alias("__with"), F.col("embedding").cast("array<double>").alias("y")), "__with").drop("__with")


def residual_variance(rows: DataFrame, group: str, values: Column, floor: float = 1e-6, least: int = 0) -> DataFrame:
    """group, pos, n, variance (sample) of each place of an array; groups of fewer than ``least`` rows take that of all rows."""
    each = rows.select(group, F.posexplode(values).alias("pos", "x"))
    own = each.groupBy(group, "pos").agg(F.count("*").alias("n"), F.var_samp("x").alias("v"))
    if not least:
        return own.select(group, "pos", "n", F.greatest("v", F.lit(floor)).alias("variance"))
    whole = each.groupBy("pos").agg(F.var_samp("x").alias("gv"))
    return own.join(whole, "pos").select(group, "pos", "n", F.when(F.col("n") < least, F.col("gv")).otherwise(F.greatest("v", F.lit(floor))).alias("variance"))


def residual_scores(pairs: DataFrame, beta: float = 0.25, eps: float = 1e-6) -> DataFrame:
    """vec_id and cosine distance with a share of the squared residual: of unit vectors (legacy, 0 at least), plain (raw_mse), or over the group's variances (var_calibrated)."""
    v = residual_variance(pairs, "label", F.zip_with("p", "y", lambda a, b: a - b), eps)
    # one array for each group, as long as a vector
    scale = v.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "variance"))), lambda x: x["variance"]).alias("variances"))
    calibrated = total(F.zip_with(squares("p", "y"), "variances", lambda s, x: s / (x + eps)))
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-8)))
    units = pairs.withColumns({"__p": unit("p"), "__y": unit("y")})
    legacy = F.greatest(cosine_distance("p", "y") + beta * mse("__p", "__y"), F.lit(0.0))
    return units.join(scale, "label").select("vec_id", legacy.alias("legacy"), (cosine_distance("p", "y") + beta * mse("p", "y")).alias("raw_mse"), (cosine_distance("p", "y") + beta * calibrated).alias("var_calibrated"))


def targets(pairs: DataFrame, alpha: float = 0.5, mixture: float = 0.5) -> DataFrame:
    """vec_id, pos and targets for every dimension, of a pair's ends p and action y: weighted, of the pair alone, their mean with the action, and a mixture of the last two."""
    def each(p, y):
        event, pair = (p + y + p) / 3, (p + y) / 2
        weighted = (p + alpha * y + p) / (2 + alpha)
        return F.struct(weighted.alias("weighted_target"), pair.alias("pair_target"), event.alias("event_target"), (mixture * event + (1 - mixture) * pair).alias("mixture_target"))

    return pairs.select("vec_id", F.posexplode(F.zip_with("p", "y", each)).alias("pos", "t")).select("vec_id", "pos", "t.*")


def top_residuals(pairs: DataFrame, k: int = 3) -> DataFrame:
    """vec_id, r, pos, residual: the k places with the largest absolute difference, the first of equal ones first."""
    each = F.transform(F.zip_with("p", "y", lambda a, b: F.abs(a - b)), lambda x, i: F.struct((-x).alias("minus"), i.alias("pos")))
    return pairs.select("vec_id", F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("at", "t")).select("vec_id", (F.col("at") + 1).alias("r"), "t.pos", (-F.col("t.minus")).alias("residual"))


def hash_sketch(tokens: DataFrame) -> DataFrame:
    """node_id, bucket, value: signed feature hashing of tokens into 16 buckets, scaled to unit length."""
    h = F.md5(F.col("token").cast("binary"))
    signed = F.when(F.substring(h, 2, 1) < "8", 1).otherwise(-1)
    b = tokens.select("node_id", F.substring(h, 1, 1).alias("bucket"), signed.alias("v")).groupBy("node_id", "bucket").agg(F.sum("v").alias("v"))
    norm = b.groupBy("node_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v")).cast("double")).alias("norm"))
    return b.join(norm, "node_id").select("node_id", "bucket", F.coalesce(F.col("v") / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0)).alias("value"))
