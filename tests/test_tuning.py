import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcohort.functions.scalars import combo_key
from sparkcohort.operators import cluster, describe, order, pairs, stats
from sparkcohort.plans import tuning
from sparkcohort.sources.params import BadEntry, read_method


def points(spark, n=15, seed=3):
    rng = np.random.default_rng(seed)
    x = np.repeat([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]], n, 0) + rng.normal(0, 0.4, (3 * n, 2))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>"), x


@pytest.mark.parametrize("method, axis", [("hac", {"k": [2, 3, 1], "linkage": ["ward", "average"]}), ("kmeans", {"k": [2, 3]}), ("hdbscan", {"least_size": [5, 40]})])
def test_sweep_finds_the_planted_classes(spark, method, axis):
    df, x = points(spark)
    got = tuning.tuning_sweep(df, "k", "v", method, axis, pairs.dense_pairs(df, "k", "v")).orderBy("place").collect()
    assert len(got) == np.prod([len(v) for v in axis.values()]) and [r.place for r in got] == list(range(len(got)))
    best = max((r for r in got if r.silhouette is not None), key=lambda r: r.silhouette)
    assert best.clusters == 3 and best.silhouette > 0.8
    assert all((r.note == "fewer than two clusters") == (r.clusters < 2) for r in got)


def test_sweep_equals_single_fits(spark):
    df, x = points(spark)
    _, labels = tuning.fit_sweep(df, "k", "v", "spectral", {"k": [2, 3]}, {"seed": 4})
    for k in (2, 3):
        one = {r.key: r.label for r in cluster.cluster_groups(df, None, "k", "v", "spectral", k=k, seed=4).collect()}
        assert {r.key: r.label for r in labels.filter(F.col("combo_key") == f"k={k}").collect()} == one


def test_sweep_refuses(spark):
    df, _ = points(spark)
    for grid in ({}, {"k": []}, {"k": [2, 2]}):
        with pytest.raises(ValueError):
            tuning.fit_sweep(df, "k", "v", "hac", grid)
    for method, grid in (("hac", {"q": [1]}), ("hac", {"linkage": ["ward"]}), ("none", {"k": [1]})):
        with pytest.raises(ValueError):
            tuning.fit_sweep(df, "k", "v", method, grid)
    with pytest.raises(ValueError, match="no combination"):
        tuning.fit_sweep(df, "k", "v", "hac", {"k": [2]}, {"linkage": "ward"}, "jaccard")
    for method in ("hac", "kmeans"):
        assert tuning.fit_sweep(df.limit(0), "k", "v", method, {"k": [2]})[1].count() == 0


def test_keys_are_those_of_the_table(spark):
    for combo in tuning.combinations({"a": [1, 0.5], "b": ["x", None], "c": [True]}):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in combo.items()])
        assert row.select(combo_key(list(combo)).alias("c")).first().c == tuning.key_of(combo)


def test_registry(tmp_path):
    path = tmp_path / "m.json"
    good = {"params": {"k": 4, "init": "a"}, "tuning_grid": {"k": [2, 3], "init": ["a", "b"]}, "nested_params": ["init"], "tag_param": ["k", "init"], "tag_prefix": ["n", ""], "tag_omit": {"init": "a"}, "consensus": {"monti": {"n_repeats": 5, "subsample_fraction": 0.8}}, "stability": {"nuisance_values": ["a"], "n_init_range": [1, 5], "n_repeats": 2}}

    def read(**changed):
        path.write_text(json.dumps({"kmeans": {**good, **changed}, "hac": {"params": {}}}))
        return read_method(path, "kmeans")

    entry = read()
    assert entry.tag() == "n4" and entry.tag({"init": "b"}) == "n4_b" and entry.free() == ["k"] and entry.consensus["monti"]["n_repeats"] == 5
    bare = read_method(path, "hac")
    assert (bare.grid, bare.nested, bare.tag(), bare.consensus, bare.stability) == ({}, (), None, None, None)
    bad = [{"params": 3}, {"tuning_grid": {}}, {"tuning_grid": {"k": []}}, {"tuning_grid": {"k": [1, 1], "init": ["a"]}}, {"tuning_grid": {"k": [[1]], "init": ["a"]}}, {"nested_params": ["z"]}, {"nested_params": ["k", "init"]}, {"tag_param": ["k"]}, {"tag_param": ["k", "z"]}, {"tag_prefix": ["n"]}, {"tag_omit": {"z": 1}}, {"tag_omit": {"k": 4, "init": "a"}}, {"consensus": {}}, {"consensus": {"x": {}}}, {"consensus": {"rsc": {"n_repeats": True}}}, {"consensus": {"monti": {"n_repeats": 1, "subsample_fraction": 1}}}, {"stability": {}}, {"stability": {**good["stability"], "n_init_range": [0]}}]
    for changed in bad:
        with pytest.raises(BadEntry):
            read(**changed)
    path.write_text(json.dumps({"hac": {**good, "stability": None}}))
    with pytest.raises(BadEntry, match="consensus"):
        read_method(path, "hac")
    with pytest.raises(BadEntry, match="no object"):
        read_method(path, "pca")


@pytest.mark.parametrize("rows", [[], [None], [1.0], [3.0, 1.0, 2.0, 2.0, 2.0, -5.5] * 40 + [None] + [float(i % 97) for i in range(500)]])
def test_running_equals_brute_force(spark, rows):
    known = sorted(v for v in rows if v is not None)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "k long, v double")
    cut = order.bucketed(df.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("m")), "v")
    assert {r.v: r.n for r in order.running(cut, "v", "m", "n").collect()} == {v: sum(x <= v for x in known) for v in known}
    assert {r.v: r.n for r in order.running(cut, "v", "m", "n", "min", True).collect()} == {v: min(known.count(x) for x in known if x >= v) for v in known}
    got = {(r.v, r["rank"], r.ties) for r in stats.mid_ranks(df.filter("v is not null"), "v").collect()}
    assert got == {(v, sum(x < v for x in known) + (known.count(v) + 1) / 2, known.count(v)) for v in known}


def test_adjusted_p_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p = [round(float(v), 2) for v in rng.random(300) ** 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*p, None])], "k long, p double")
    ranked = sorted(p)
    low = {v: min(1.0, min(x * len(p) / (i + 1) for i, x in enumerate(ranked) if x >= v)) for v in set(p)}
    got = {r.k: r.p_adjusted for r in stats.benjamini_hochberg(df, "k", "p").collect()}
    assert got[300] is None and len(got) == 301 and all(got[i] == low[v] for i, v in enumerate(p))


def test_ranges(spark):
    values = [*range(-5, 40), 50, *range(60, 200), None, 50]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert sorted(tuple(r) for r in describe.ranges(df, "v").collect()) == [(-5, 39), (50, 50), (60, 199)]


@pytest.mark.parametrize("metric", ["euclidean", "czekanowski", "ruzicka"])
def test_wide_vectors_by_columns(spark, metric):
    x = np.abs(np.random.default_rng(0).normal(size=(7, 3 * pairs.COLUMNS + 5)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    want = {"euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "czekanowski": lambda a, b: np.abs(a - b).sum() / (a + b).sum(), "ruzicka": lambda a, b: 1 - np.minimum(a, b).sum() / np.maximum(a, b).sum()}[metric]
    got = pairs.dense_pairs(df, "k", "v", metric, 3).collect()
    assert len(got) == 21 and all(abs(r.d - want(x[r.i], x[r.j])) < 1e-12 for r in got)
