"""Feature matrices of a cohort: admission with an audit, the features that vary, and one array a subject."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.operators import relational
from sparkcohort.operators.checks import finite_numeric, unique_key
from sparkcohort.operators.order import bucketed, running
from sparkcohort.operators.reshape import changing_features


@dataclass(frozen=True)
class Matrix:
    """rows: key, places, values (sparse, by place; absent = 0). features: feature, place. audit: key, reason. load: key, load."""

    rows: DataFrame
    features: DataFrame
    audit: DataFrame
    load: DataFrame

    def dense(self, key: str, width: int) -> DataFrame:
        """key, x: all `width` values of each subject."""
        at = F.map_from_arrays("places", "values")
        return self.rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0))).alias("x"))


def build_matrix(long: DataFrame, subjects: DataFrame, key: str, rules: Sequence[tuple[str, Column]], excluded: DataFrame | None = None, *, binary: bool = False) -> Matrix:
    """The matrix of the admitted subjects from measurements (key, feature, value; absent = 0).

    A subject is in if it is registered, passes the rules and is not excluded; the audit names the first reason of the
    others, of measured subjects that nobody registered, and of admitted ones without a measurement. Repeated subjects or
    cells, and null or infinite values, raise. binary: values become 0 or 1. Features that are constant over the matrix
    go (one subject keeps all); the load is the sum over all features before that.
    """
    unique_key(subjects, [key], "subjects")
    unique_key(long, [key, "feature"], "measurements")
    finite_numeric(long, key, "value", "measurements")
    kept, audit = relational.admit(subjects, key, rules, excluded)
    measured = long.select(key).distinct()
    strangers = measured.join(subjects.select(key), key, "left_anti").select(key, F.lit("not registered").alias("reason"))
    silent = kept.select(key).join(measured, key, "left_anti").select(key, F.lit("not measured").alias("reason"))
    value = F.col("value").cast("double")
    cells = long.select(key, "feature", (value != 0).cast("double").alias("value") if binary else value.alias("value")).join(kept.select(key), key, "left_semi")
    n = cells.select(key).distinct().count()
    places = running(bucketed(changing_features(cells, key, n).withColumn("one", F.lit(1)), "feature") if n else changing_features(cells, key, n).withColumns({"one": F.lit(1), "_bucket": F.lit(0)}), "feature", "one", "place")
    features = places.select("feature", (F.col("place") - 1).cast("int").alias("place"))
    load = cells.groupBy(key).agg(F.sum("value").alias("load"))
    filled = cells.filter("value <> 0").join(features, "feature").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("c"))
    empty = F.array().cast("array<struct<place:int,value:double>>")
    rows = load.select(key).join(filled, key, "left").withColumn("c", F.coalesce("c", empty)).select(key, F.col("c.place").alias("places"), F.col("c.value").alias("values"))
    return Matrix(rows, features, audit.unionByName(strangers).unionByName(silent), load)
