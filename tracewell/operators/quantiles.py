"""Exact quantiles of groups without sorting any group whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_EPS, _ACCURACY = 3e-4, 10_000


def quantiles_higher(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """keys, n, vmax and, for each name in ``qs``, the value of rank ceil(q * (n - 1)) of each group.

    A mergeable sketch brackets all ranks in one pass (its error is at most 1 / _ACCURACY of the rows, a third of what the
    bracket spans). In the second, values below a bracket are only counted, and those within it are counted by value, so that
    the ordered part holds a few ten-thousandths of the distinct values, however large a group is. A rank that is not in
    its bracket ends the job instead of giving another value.
    """
    names, ps = list(qs), list(qs.values())
    edges = F.percentile_approx(value, [p for q in ps for p in (max(0.0, q - _EPS), min(1.0, q + _EPS))], F.lit(_ACCURACY))
    bounds = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), edges.alias("edges"), F.max(value).alias("vmax"))
    b = bounds.select(*(F.col(k).alias(f"__{k}") for k in keys), "n", "edges", "vmax")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    # for each quantile whose bracket doesn't end below the value: its number, and the value if the bracket doesn't begin above it
    slots = F.filter(F.array(*(F.when(F.col(value) <= F.col("edges")[2 * i + 1], F.struct(F.lit(i).alias("q"), F.when(F.col(value) >= F.col("edges")[2 * i], F.col(value)).alias("x"))) for i in range(len(ps)))), lambda s: s.isNotNull())
    near = df.join(b, same).select(*keys, "n", "vmax", F.explode(slots).alias("s"))
    counts = near.groupBy(*keys, "n", "vmax", F.col("s.q").alias("q"), F.col("s.x").alias("x")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "q").orderBy(F.asc_nulls_first("x")))
    rank = F.element_at(F.array(*(F.ceil(F.lit(float(p)) * (F.col("n") - 1)) for p in ps)), F.col("q") + 1)
    hit = F.when(F.col("upto") - 1 >= rank, F.when(F.col("x").isNull(), F.raise_error(F.lit("a quantile's rank lies below its bracket"))).otherwise(F.col("x")))
    picked = counts.withColumn("upto", upto).groupBy(*keys, "n", "vmax", "q").agg(F.min(hit).alias("v"))
    found = lambda i, n: F.max(F.when(F.col("q") == i, F.coalesce(F.col("v"), F.raise_error(F.lit("a quantile's rank lies above its bracket")).cast(df.schema[value].dataType)))).alias(n)
    return picked.groupBy(*keys).agg(F.max("n").alias("n"), *(found(i, n) for i, n in enumerate(names)), F.max("vmax").alias("vmax"))


def quantile_higher(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """One quantile of each group: keys, n, the value, vmax."""
    return quantiles_higher(df, keys, value, {out: q})
