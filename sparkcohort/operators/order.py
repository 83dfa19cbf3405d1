"""Running sums and minima over a whole table: the order is cut into buckets at quantiles, so no single task orders all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def bucketed(df: DataFrame, order: str, buckets: int = BUCKETS) -> DataFrame:
    """df with _bucket, which rises with the order; equal values share one, nulls come first.

    The bounds are quantiles of 16 values a bucket, those with the smallest hashes: they decide how even the buckets are,
    not what is counted, and they are all that the driver sees. Any type that can be ordered will do.
    """
    seen = df.select(order).filter(F.col(order).isNotNull()).distinct().orderBy(F.xxhash64(order), order).limit(16 * buckets)
    values = [v for (v,) in seen.sort(order).collect() if v == v]
    bounds = list(dict.fromkeys(values[i * len(values) // buckets] for i in range(1, buckets))) if values else []
    kind = df.schema[order].dataType
    place = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b < F.col(order))) if bounds else F.lit(0)
    return df.withColumn("_bucket", place)


def running(df: DataFrame, order: str, value: str, name: str, how: str = "sum", descending: bool = False) -> DataFrame:
    """df (of `bucketed`, one row for each value of the order) with the sum or minimum of value over all rows up to each, itself included.

    A window in each bucket, and what the buckets before it hold: one row a bucket, broadcast.
    """
    if how not in ("sum", "min"):
        raise ValueError(f"unknown {how!r}")
    fold = F.sum if how == "sum" else F.min
    turn = F.desc if descending else F.asc
    per = df.groupBy("_bucket").agg(fold(value).alias("_part"))
    earlier = per.select("_bucket", fold("_part").over(Window.orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    here = fold(value).over(Window.partitionBy("_bucket").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0))
    both = F.least("_here", "_earlier") if how == "min" else F.coalesce("_here", F.lit(0)) + F.coalesce("_earlier", F.lit(0))
    return df.withColumn("_here", here).join(F.broadcast(earlier), "_bucket").withColumn(name, both).drop("_here", "_earlier")
