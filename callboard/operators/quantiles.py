"""Exact quantiles of groups of any size.

Equal values are counted first; the range of values is cut into buckets whose totals say which few
hold the wanted ranks; only the distinct values of those are put in order, bucket by bucket.  No task
holds a whole group, however many distinct values it has.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: tuple[float, ...], buckets: int = BUCKETS) -> DataFrame:
    """(keys, n, q): how many values each group has and their quantiles, by linear interpolation
    between neighbours, as an array.  Nulls do not count; null keys are groups like any other; groups
    without a value have no row.  Without keys there is one group."""
    keyed = [f"__k{i}" for i in range(len(keys))]
    v = F.col(value).cast("double")
    counts = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(keys, keyed, strict=True)), v.alias("__v")).groupBy(*keyed, "__v").agg(F.count(F.lit(1)).alias("__n"))
    edges = counts.agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))  # one row
    place = F.floor((F.col("__v") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)) * buckets)
    counts = counts.crossJoin(F.broadcast(edges)).withColumn("__b", F.coalesce(place, F.lit(0))).drop("__low", "__high")

    by, whole = Window.partitionBy(*keyed).orderBy("__b"), Window.partitionBy(*keyed)
    sizes = counts.groupBy(*keyed, "__b").agg(F.sum("__n").alias("__size"))  # so many buckets a group, at most
    sizes = sizes.select(*keyed, "__b", (F.sum("__size").over(by) - F.col("__size")).alias("__before"), "__size", F.sum("__size").over(whole).alias("n"))

    def spot(p: float) -> Column:
        return F.lit(p) * (F.col("n") - 1)

    def ranks(p: float) -> tuple[Column, Column]:
        return F.floor(spot(p)), F.ceil(spot(p))

    wanted = [r for p in probabilities for r in ranks(p)]
    holds = reduce(lambda a, b: a | b, ((r >= F.col("__before")) & (r < F.col("__before") + F.col("__size")) for r in wanted))
    named = sizes.where(holds).drop("__size")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keyed, "__b")]
    near = counts.alias("c").join(named.alias("s"), reduce(lambda a, b: a & b, same)).select(*(F.col(f"c.{k}") for k in keyed), "c.__b", "__v", "__n", "__before", "n")
    ordered = Window.partitionBy(*keyed, "__b").orderBy("__v")
    near = near.withColumn("__to", F.col("__before") + F.sum("__n").over(ordered)).withColumn("__from", F.col("__to") - F.col("__n"))
    at = lambda r: F.max(F.when((r >= F.col("__from")) & (r < F.col("__to")), F.col("__v")))
    picked = near.groupBy(*keyed, "n").agg(*(at(r).alias(f"__{side}{i}") for i, p in enumerate(probabilities) for side, r in zip("lh", ranks(p), strict=True)))

    def between(i: int, p: float) -> Column:
        low, high = F.col(f"__l{i}"), F.col(f"__h{i}")
        return low + (high - low) * (spot(p) - F.floor(spot(p)))

    if any(not 0 <= p <= 1 or math.isnan(p) for p in probabilities):
        raise ValueError(f"probabilities lie in 0..1: {probabilities}")
    return picked.select(*(F.col(k).alias(c) for k, c in zip(keyed, keys, strict=True)), "n", F.array(*(between(i, p) for i, p in enumerate(probabilities))).alias("q"))
