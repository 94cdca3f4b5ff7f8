"""Exact quantiles of few large groups, without a group in one task."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Estimated quantiles are off by a rank of one in so many at most.
ACCURACY = 2000


def exact_quantiles(df: DataFrame, key: str, value: str, shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """key and quantiles: an array with the interpolated quantile at each share, as ``percentile`` gives; null values don't count.

    Estimated quantiles two errors below and above each share bound the values among which its place must be. Rows below
    are counted, in each task first; only those between the bounds, few thousandths of a group and its ties, are counted
    by value and ordered. The estimates decide how many rows that are, never the result. Groups without values are left out.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).alias("_v")).where("_v IS NOT NULL")
    low, high = [max(s - 2 / accuracy, 0.0) for s in shares], [min(s + 2 / accuracy, 1.0) for s in shares]
    cuts = rows.groupBy("_k").agg(F.percentile_approx("_v", [*low, *high], accuracy).alias("_cuts")).withColumnRenamed("_k", "_c")
    placed = rows.join(F.broadcast(cuts), F.col("_k").eqNullSafe(F.col("_c")))
    cut = lambda i: F.get("_cuts", F.lit(i))
    under = [F.col("_v") < cut(i) if low[i] > 0 else F.lit(False) for i in range(len(shares))]
    over = [F.col("_v") > cut(len(shares) + i) if high[i] < 1 else F.lit(False) for i in range(len(shares))]
    within = [~u & ~o for u, o in zip(under, over, strict=True)]

    sums = placed.groupBy(F.col("_k").alias("_c")).agg(F.count(F.lit(1)).alias("_all"), F.array(*[F.count_if(u) for u in under]).alias("_under"), F.array(*[F.max(F.when(u, F.col("_v"))) for u in under]).alias("_last"), F.array(*[F.min(F.when(o, F.col("_v"))) for o in over]).alias("_next"))
    near = placed.where(reduce(or_, within)).select("_k", "_v", F.explode(F.array_compact(F.array(*[F.when(w, i) for i, w in enumerate(within)]))).alias("_i"))
    counted = near.groupBy("_k", "_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
    first = F.sum("_n").over(Window.partitionBy("_k", "_i").orderBy("_v")) - F.col("_n")
    at = counted.withColumn("_first", first).join(F.broadcast(sums), F.col("_k").eqNullSafe(F.col("_c")))
    place = F.get(F.array(*map(F.lit, shares)), "_i") * (F.col("_all") - 1) - F.get("_under", "_i")

    def end(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_n")), F.col("_v")))

    ends = at.groupBy("_k", "_i").agg(F.max(place).alias("_p"), end(F.floor(place)).alias("_lower"), end(F.ceil(place)).alias("_upper"), F.sum("_n").alias("_n"), F.max(F.get("_last", "_i")).alias("_last"), F.max(F.get("_next", "_i")).alias("_next"))
    p = F.col("_p")  # in small groups a place may be that just before or just after the rows between the bounds
    ends = ends.withColumn("_lower", F.when(F.floor(p) == -1, F.col("_last")).otherwise(F.col("_lower"))).withColumn("_upper", F.when(F.ceil(p) == F.col("_n"), F.col("_next")).otherwise(F.col("_upper")))
    between = F.when(F.floor(p) == F.ceil(p), F.coalesce("_lower", "_upper")).otherwise((F.ceil(p) - p) * F.col("_lower") + (p - F.floor(p)) * F.col("_upper"))
    pairs = ends.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", between.alias("q")))).alias("_q"))
    return pairs.select(F.col("_k").alias(key), F.transform("_q", lambda s: s["q"]).alias("quantiles"))
