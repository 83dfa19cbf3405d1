"""Descriptions of clusters and partitions: grouped summaries over ALL rows, nulls counted as missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.functions.scalars import NOISE
from sparkcohort.operators.order import bucketed, running


def numeric_summary(df: DataFrame, group: str | None, value: str) -> DataFrame:
    """n_available, n_total, mean, median, sd (n - 1; null below two values), min, max."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    aggs = [F.count(v).alias("n_available"), F.count(F.lit(1)).alias("n_total"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max")]
    return df.groupBy(*([F.col(group).alias("group")] if group else [])).agg(*aggs)


def category_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, category, n; null and empty are left out."""
    return df.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(F.col(group).alias("group"), F.col(value).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def group_summary(df: DataFrame, members: DataFrame, key: str, value: str) -> DataFrame:
    """The numeric summary of arbitrary, perhaps overlapping groups. members: group_id, key."""
    return numeric_summary(members.join(df, key), "group_id", value)


def partition_shape(df: DataFrame, label: str) -> DataFrame:
    """One row: n, clusters, noise, noise_fraction, largest_share; shares are over all rows, the last null without a cluster."""
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("m"))
    real = F.col("label") != NOISE
    n = F.sum("m")
    return sizes.agg(n.alias("n"), F.count_if(real).alias("clusters"), F.coalesce(F.sum(F.when(~real, F.col("m"))), F.lit(0)).alias("noise"), (F.coalesce(F.sum(F.when(~real, F.col("m"))), F.lit(0)) / n).alias("noise_fraction"), (F.max(F.when(real, F.col("m"))) / n).alias("largest_share"))


def silhouette_breakdown(samples: DataFrame, label: str = "label", value: str = "silhouette") -> DataFrame:
    """Per cluster n, mean and share of negative values."""
    return samples.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) < 0).cast("double")).alias("negative_share"))


def membership_summary(df: DataFrame, label: str, membership: str) -> DataFrame:
    """Per cluster n, mean membership in it, and the other cluster with the highest mean (the smallest of equals)."""
    long = df.filter(F.col(label) != NOISE).select(F.col(label).alias("label"), F.posexplode(membership).alias("of", "p"))
    means = long.groupBy("label", "of").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean"))
    own = means.filter("label = of").select("label", "n", F.col("mean").alias("own_mean"))
    other = means.filter("label <> of").groupBy("label").agg(F.max(F.struct("mean", (-F.col("of")).alias("o"))).alias("x")).select("label", (-F.col("x.o")).alias("best_other"), F.col("x.mean").alias("best_other_mean"))
    return own.join(other, "label", "left")


def own_membership(label: str, membership: str) -> Column:
    """A row's membership in its own cluster; null for noise."""
    return F.when(F.col(label) != NOISE, F.get(membership, F.col(label)))


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, accuracy, n of predicting score >= threshold. The grid is a column of literals, so rows are read once."""
    hits = [F.avg((F.coalesce(F.col(score) >= t, F.lit(False)).cast("int") == F.col(truth)).cast("double")).alias(f"t{i}") for i, t in enumerate(thresholds)]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *hits)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("accuracy")) for i, t in enumerate(thresholds)]))
    return wide.select("n", rows.alias("x")).select("x.threshold", "x.accuracy", "n")


def confusion(df: DataFrame, predicted: str, truth: str, values: Sequence[str]) -> DataFrame:
    """Full table of the given values, zeros included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in values for b in values], "predicted string, truth string")
    cells = df.groupBy(F.col(predicted).alias("predicted"), F.col(truth).alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(cells, ["predicted", "truth"], "left").na.fill({"n": 0})


def fractions(df: DataFrame, subject: str, category: str, order: Sequence[str]) -> DataFrame:
    """Per subject: total, one fraction per category, and dominant (of equals the first in the given order)."""
    total = F.count(F.lit(1))
    cols = [F.count_if(F.col(category) == c).alias(f"n_{c}") for c in order]
    wide = df.groupBy(subject).agg(total.alias("total"), *cols)
    best = F.greatest(*[F.col(f"n_{c}") for c in order]) if len(order) > 1 else F.col(f"n_{order[0]}")
    dominant = F.coalesce(*[F.when((F.col(f"n_{c}") == best) & (best > 0), c) for c in order])
    return wide.select(subject, "total", *[(F.col(f"n_{c}") / F.col("total")).alias(f"fraction_{c}") for c in order], dominant.alias("dominant"))


def cumulative_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, rank, share, cumulative from the largest value down. For spectra and other short lists: one task orders them."""
    w = Window.orderBy(F.desc(value), key)
    total = F.sum(value).over(Window.partitionBy())
    return df.select(key, F.row_number().over(w).alias("rank"), (F.col(value) / total).alias("share"), (F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cumulative"))


def components_for_share(shares: DataFrame, share: float) -> DataFrame:
    """One row: the fewest items that reach the share."""
    return shares.filter(F.col("cumulative") >= share - 1e-12).agg(F.min("rank").alias("n_components"))


def ranges(df: DataFrame, value: str) -> DataFrame:
    """first, last of each run of consecutive whole numbers (gaps and islands over the distinct values)."""
    v = bucketed(df.select(F.col(value).alias("v")).filter("v is not null").distinct().withColumn("one", F.lit(1)), "v")
    return running(v, "v", "one", "place").withColumn("island", F.col("v") - F.col("place")).groupBy("island").agg(F.min("v").alias("first"), F.max("v").alias("last")).drop("island")


def top_per_group(df: DataFrame, group: Sequence[str], value: str, n: int, ties: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last(value), *ties)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def previous_value(df: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """The value of the next lower entry of the same group, and the change."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    return df.withColumns({"previous": before, "change": F.col(value) - before})


def ordered_values(df: DataFrame, value: str, preferred: Sequence[str]) -> DataFrame:
    """value, place: distinct values, the preferred ones first in their order, then the others sorted."""
    d = df.select(F.col(value).alias("value")).distinct()
    known = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("value")) if preferred else F.lit(0)
    first = F.when(known > 0, known).otherwise(len(preferred) + 1)
    return d.withColumn("place", F.row_number().over(Window.orderBy(first, "value")))


def representative_values(df: DataFrame, value: str) -> DataFrame:
    """One row: the smallest, the upper middle and the largest of the distinct values."""
    v = df.agg(F.array_sort(F.collect_set(value)).alias("v"))  # a parameter's values: a few
    n = F.size("v")
    return v.select(F.array_distinct(F.array(F.get("v", F.lit(0)), F.get("v", F.floor(n / 2).cast("int")), F.get("v", n - 1))).alias("values"))
