"""Long and wide forms of feature matrices; in the sparse long form an absent row is a zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_features(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("feature", "value"))


def changing_features(long: DataFrame, key: str, n_rows: int | None = None) -> DataFrame:
    """feature of the columns that are not constant. A column with a NaN stays, one with fewer than n_rows rows has zeros; one row only keeps all."""
    v = F.col("value").cast("double")
    nan = F.isnan(v)
    low, high = F.min(F.when(~nan, v)), F.max(F.when(~nan, v))
    per = long.groupBy("feature").agg(low.alias("low"), high.alias("high"), F.count_if(nan).alias("nans"), F.count(F.lit(1)).alias("m"))
    if n_rows is not None:
        holes = F.col("m") < n_rows
        per = per.withColumns({"low": F.when(holes, F.least("low", F.lit(0.0))).otherwise(F.col("low")), "high": F.when(holes, F.greatest("high", F.lit(0.0))).otherwise(F.col("high"))})
    return per.filter((F.col("low") != F.col("high")) | (F.col("nans") > 0) | F.lit(n_rows == 1)).select("feature")


def drop_constant_features(long: DataFrame, key: str, n_rows: int | None = None) -> DataFrame:
    return long.join(changing_features(long, key, n_rows), "feature", "left_semi")


def pivot_fixed(df: DataFrame, key: str, column: str, value: Column, names: Sequence[str], fill: float | None = 0) -> DataFrame:
    """One column per given name in one aggregate; without a fill, missing cells stay null."""
    cells = [F.sum(F.when(F.col(column) == n, value)).alias(str(n)) for n in names]
    wide = df.groupBy(key).agg(*cells)
    return wide if fill is None else wide.na.fill(fill, [str(n) for n in names])


def upper_triangle(square: DataFrame, i: str, j: str, value: str, separator: str = "__") -> DataFrame:
    """edge (i__j), value for i < j of a symmetric table; a name that holds the separator, or an asymmetric pair, raises."""
    for side in (i, j):
        if not square.filter(F.contains(F.col(side), F.lit(separator))).isEmpty():
            raise ValueError(f"{side}: a node name holds {separator!r}")
    a = square.select(F.least(i, j).alias("lo"), F.greatest(i, j).alias("hi"), F.when(F.col(i) < F.col(j), F.col(value)).alias("u"), F.when(F.col(i) > F.col(j), F.col(value)).alias("l")).filter("lo <> hi")
    both = a.groupBy("lo", "hi").agg(F.max("u").alias("u"), F.max("l").alias("l"))
    if not both.filter(~F.col("u").eqNullSafe(F.col("l"))).isEmpty():
        raise ValueError("the matrix is not symmetric")
    return both.select(F.concat_ws(separator, "lo", "hi").alias("edge"), F.col("u").alias(value))


def mask_nodes(square: DataFrame, bad: DataFrame, node: str, i: str, j: str, value: str) -> DataFrame:
    """value null in rows and columns of the bad nodes."""
    names = bad.select(F.col(node).alias("_n")).distinct()
    out = square
    for side in (i, j):
        out = out.join(names.withColumnRenamed("_n", f"_{side}"), F.col(side) == F.col(f"_{side}"), "left")
    return out.withColumn(value, F.when(F.col(f"_{i}").isNull() & F.col(f"_{j}").isNull(), F.col(value))).drop(f"_{i}", f"_{j}")


def overlap_map(long: DataFrame, subject: str, cell: str, n_subjects: int) -> DataFrame:
    """cell, n, percent of subjects that have it."""
    return long.groupBy(cell).agg(F.countDistinct(subject).alias("n")).withColumn("percent", 100.0 * F.col("n") / n_subjects)


def mean_map(long: DataFrame, cell: str, value: str, n_subjects: int) -> DataFrame:
    """cell, mean over all subjects: absent rows count as 0."""
    return long.groupBy(cell).agg((F.sum(F.col(value).cast("double")) / n_subjects).alias("mean"))


def difference_map(a: DataFrame, b: DataFrame, cell: str, value: str) -> DataFrame:
    left, right = a.select(cell, F.col(value).alias("_a")), b.select(cell, F.col(value).alias("_b"))
    return left.join(right, cell, "full_outer").select(cell, (F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("difference"))


def coverage(labels: DataFrame, damaged: DataFrame, cell: str, label: str) -> DataFrame:
    """label, coverage: the share of its cells that are not damaged; 0 where none is left."""
    hit = damaged.select(F.col(cell).alias("_c")).distinct()
    return labels.join(hit, F.col(cell) == F.col("_c"), "left").groupBy(label).agg(F.avg(F.col("_c").isNull().cast("double")).alias("coverage"))


def feature_arrays(long: DataFrame, key: str) -> DataFrame:
    """key, x: the values in the order of features."""
    return long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("_x")).select(key, F.transform("_x", lambda v: v["value"]).alias("x"))
