"""Voxel grids as tables: (subject, i, j, k, value) with a grid's shape and affine (4 x 4, row-major)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def voxel_id(i: Column, j: Column, k: Column, shape: Sequence[int]) -> Column:
    """Row-major number of a voxel."""
    return (i * shape[1] + j) * shape[2] + k


def needs_resample(shape: Sequence[int], affine: np.ndarray, to_shape: Sequence[int], to_affine: np.ndarray, tolerance: float = 1e-6) -> bool:
    return tuple(shape) != tuple(to_shape) or not np.allclose(affine, to_affine, atol=tolerance)


def is_voxel_map(affine: np.ndarray, to_affine: np.ndarray, tolerance: float = 1e-6) -> bool:
    """Whether one grid's voxels are the other's but for flips, axis order and whole shifts."""
    m = np.linalg.inv(to_affine) @ affine
    r = np.round(m)
    return bool(np.allclose(m, r, atol=tolerance) and (np.abs(r[:3, :3]).sum(0) == 1).all() and (np.abs(r[:3, :3]).sum(1) == 1).all())


def resample_nearest(voxels: DataFrame, affine: np.ndarray, to_shape: Sequence[int], to_affine: np.ndarray) -> DataFrame:
    """voxels on another grid by nearest neighbour, by arithmetic on the indexes: each target voxel reads the source voxel nearest to its centre. voxels: subject, i, j, k, value."""
    spark = voxels.sparkSession
    m = np.linalg.inv(affine) @ to_affine
    n = int(np.prod(to_shape))
    grid = spark.range(n).select(F.floor(F.col("id") / (to_shape[1] * to_shape[2])).alias("ti"), (F.floor(F.col("id") / to_shape[2]) % to_shape[1]).alias("tj"), (F.col("id") % to_shape[2]).alias("tk"))
    at = lambda row: F.floor(F.col("ti") * float(m[row, 0]) + F.col("tj") * float(m[row, 1]) + F.col("tk") * float(m[row, 2]) + float(m[row, 3]) + 0.5)
    grid = grid.select("ti", "tj", "tk", at(0).alias("i"), at(1).alias("j"), at(2).alias("k"))
    return voxels.join(grid, ["i", "j", "k"]).select("subject", F.col("ti").alias("i"), F.col("tj").alias("j"), F.col("tk").alias("k"), "value")


def binarize(voxels: DataFrame, threshold: float) -> DataFrame:
    """Voxels strictly above the threshold."""
    return voxels.filter(F.col("value") > threshold).withColumn("value", F.lit(1))


def hemisphere(affine: np.ndarray) -> Column:
    """left below 0 and right above in world x; null on the midline."""
    x = F.col("i") * float(affine[0, 0]) + F.col("j") * float(affine[0, 1]) + F.col("k") * float(affine[0, 2]) + float(affine[0, 3])
    return F.when(x < 0, "left").when(x > 0, "right")


def lesion_metrics(mask: DataFrame, affine: np.ndarray, brain: DataFrame | None = None) -> DataFrame:
    """subject, volume, out_of_brain_fraction (before correction; null for an empty mask), left, right. brain: i, j, k."""
    side = mask.withColumn("side", hemisphere(affine))
    inside = F.lit(True)
    if brain is not None:
        side = side.join(brain.select("i", "j", "k", F.lit(1).alias("in_brain")), ["i", "j", "k"], "left")
        inside = F.col("in_brain").isNotNull()
    return side.groupBy("subject").agg(F.count_if(inside).alias("volume"), F.avg((~inside).cast("double")).alias("out_of_brain_fraction"), F.count_if(inside & (F.col("side") == "left")).alias("left"), F.count_if(inside & (F.col("side") == "right")).alias("right"))


def location_categories(voxels: DataFrame, rules: Sequence[tuple[str, Column]], default: str) -> DataFrame:
    """category of each voxel: the first rule that holds."""
    out = F.lit(default)
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return voxels.withColumn("category", out)


def centroid_sides(labels: DataFrame, affine: np.ndarray, label: str) -> DataFrame:
    """label, x: mean world x, to check that an atlas's sides have the right sign."""
    x = F.col("i") * float(affine[0, 0]) + F.col("j") * float(affine[0, 1]) + F.col("k") * float(affine[0, 2]) + float(affine[0, 3])
    return labels.groupBy(label).agg(F.avg(x).alias("x"))
