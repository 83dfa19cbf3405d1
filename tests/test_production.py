import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcohort.operators import cluster, pairs, reduce, reshape
from sparkcohort.plans import matrices, production


def cohort(spark, n=12, seed=5, dims=2):
    rng = np.random.default_rng(seed)
    x = np.repeat(np.eye(3, dims) * 9, n, 0) + rng.normal(0, 0.4, (3 * n, dims))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, x array<double>"), x


def test_hac_results(spark, tmp_path):
    rows, _ = cohort(spark)
    labels = cluster.cluster_groups(rows, None, "key", "x", "hac", k=3, linkage="average").select("key", "label")
    results, clusters = production.hac_results(rows, labels, "average")
    got = {r.metric: (r.value, r.note) for r in results.collect()}
    assert tuple(got) == production.METRICS["hac"] and got["silhouette"][0] > 0.8 and got["dendrogram_jump"][0] > 2 and all(n is None for _, n in got.values())
    assert sorted(r.n for r in clusters.collect()) == [12, 12, 12]
    folder = f"file:{tmp_path}/run"
    production.save_results(spark, folder, "hac", results, clusters, {"k": 3})
    assert {r.metric: r.value for r in production.read_results(spark, folder)[0].collect()} == pytest.approx({k: v for k, (v, _) in got.items()})
    other = labels.withColumn("label", (F.col("key") % 3).cast("int"))
    assert {r.metric: r.note for r in production.hac_results(rows, other, "average")[0].collect()}["dendrogram_jump"] == "the tree does not give these labels"
    one = {r.metric: r for r in production.hac_results(rows, labels.withColumn("label", F.lit(0)), "average")[0].collect()}
    assert one["silhouette"].value is None and one["dunn"].note == "fewer than two clusters" and one["davies_bouldin"].note


def test_density_results(spark):
    rows, x = cohort(spark)
    labels = cluster.cluster_groups(rows, None, "key", "x", "hdbscan", least_size=5).select("key", "label").withColumn("membership", F.when(F.col("label") >= 0, F.lit(0.5)))
    results, clusters = production.density_results(rows, labels)
    got = {r.metric: (r.value, r.note) for r in results.collect()}
    y = np.array([r.label for r in labels.orderBy("key").collect()])
    assert tuple(got) == production.METRICS["hdbscan"] and got["clusters"][0] == 3 and got["membership_mean"][0] == 0.5
    assert abs(got["dbcv"][0] - cluster.dbcv(cluster.distance_matrix(x), y, 2)) < 1e-12
    assert {r.cluster: r.dbcv for r in clusters.collect()} == pytest.approx(cluster.dbcv_scores(cluster.distance_matrix(x), y, 2))
    none = {r.metric: r.note for r in production.density_results(rows, labels.select("key", F.lit(-1).alias("label"), F.lit(None).cast("double").alias("membership")))[0].collect()}
    assert none["membership_mean"] == "no cluster" and none["dbcv"] == "fewer than two clusters"
    alone = labels.withColumn("label", F.when(F.col("key") == 0, 7).otherwise(F.col("label"))).withColumn("membership", F.when(F.col("label") >= 0, F.lit(1.0)))
    assert "one row" in {r.metric: r.note for r in production.density_results(rows, alone)[0].collect()}["dbcv"]
    with pytest.raises(ValueError, match="membership"):
        production.density_results(rows, labels.withColumn("label", F.lit(-1)))


def test_dual_pca_equals_pca(spark):
    rows, x = cohort(spark, 6, dims=40)
    dual = reduce.DualPca(pairs.dense_pairs(rows, "key", "x").toPandas(), 30)
    plain = reduce.Pca(rows, "x")
    assert dual.kept == 17 and np.allclose(dual.values, plain.values[:17])
    load = {(r.component, r.feature): r.loading for r in dual.loadings(reshape.explode_features(rows, "key", "x"), "key").collect()}
    w = np.array([[load[c, f] for f in range(40)] for c in range(17)])
    assert np.allclose(w @ w.T, np.eye(17), atol=1e-8) and np.allclose(np.abs(w @ plain.vectors[:, :17]), np.eye(17), atol=1e-6)
    assert np.allclose((x - x.mean(0)) @ w.T, dual.coordinates.drop(columns="id").to_numpy(), atol=1e-8)


def test_matrix(spark):
    subjects = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0), ("d", 1), ("e", 1), ("f", None)], "s string, ok int")
    long = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 1.0), ("b", "y", 1.0), ("b", "z", 0.0), ("d", "x", 5.0), ("z", "x", 1.0), ("c", "q", 4.0)], "s string, feature string, value double")
    out = spark.createDataFrame([("d",)], "s string")
    m = matrices.build_matrix(long, subjects, "s", [("not ok", F.col("ok") == 1)], out)
    assert {(r.s, r.reason) for r in m.audit.collect()} == {("c", "not ok"), ("f", "not ok"), ("d", "excluded by list"), ("z", "not registered"), ("e", "not measured")}
    assert {r.feature: r.place for r in m.features.collect()} == {"x": 0}
    assert {r.s: r.x for r in m.dense("s", 1).collect()} == {"a": [2.0], "b": [0.0]}
    assert {r.s: r.load for r in m.load.collect()} == {"a": 3.0, "b": 1.0}
    ones = matrices.build_matrix(long, subjects, "s", [], binary=True)
    assert {r.s: r.x for r in ones.dense("s", 3).collect()}["d"] == [0.0, 1.0, 0.0] and ones.features.count() == 3
    none = matrices.build_matrix(long.limit(0), subjects, "s", [])
    assert none.rows.count() == none.features.count() == 0 and none.audit.count() == 6
    for bad in (long.union(long), long.withColumn("value", F.lit(float("inf")))):
        with pytest.raises(ValueError):
            matrices.build_matrix(bad, subjects, "s", [])
