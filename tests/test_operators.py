import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkcohort.functions import scalars as S
from sparkcohort.operators import checks, cluster, compare, describe, pairs, reduce, relational, reshape, spatial, stability, stats, sweep, tree, validity
from sparkcohort.sources import artifacts, tables

COMMON = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
LABELS = st.lists(st.tuples(st.sampled_from([-1, 0, 1, 3, 7, 12]), st.sampled_from([-1, 0, 1, 3, 7, 12])), min_size=2, max_size=40)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@COMMON
@given(LABELS)
def test_pair_counts_equal_enumeration(spark, rows):
    got = compare.pair_counts(frame(spark, rows, "a int, b int")).first()
    want = [0, 0, 0, 0]
    for i in range(len(rows)):
        for j in range(i):
            want[2 * (rows[i][0] != rows[j][0]) + (rows[i][1] != rows[j][1])] += 1
    assert list(got) == [want[0], want[1], want[2], want[3]]


@COMMON
@given(LABELS)
def test_agreement_is_one_with_itself_and_symmetric(spark, rows):
    same = compare.agreement(frame(spark, [(a, a) for a, _ in rows], "a int, b int")).first()
    assert all(abs(v - 1) < 1e-9 for v in list(same)[1:])
    x, y = compare.agreement(frame(spark, rows, "a int, b int")).first(), compare.agreement(frame(spark, [(b, a) for a, b in rows], "a int, b int")).first()
    assert abs(x.ari - y.ari) < 1e-9 and abs(x.nmi - y.nmi) < 1e-9 and abs(x.homogeneity - y.completeness) < 1e-9


def test_noise_and_degenerate_indices(spark):
    df = frame(spark, [(1, -1, 0), (2, -1, 0), (3, 0, 1)], "k int, a int, b int")
    assert compare.noise_as_singletons(df, "a", "k").select("a").distinct().count() == 3
    assert compare.external_indices(frame(spark, [(0, 0), (0, 1)], "a int, b int")).first().note
    shape = describe.partition_shape(frame(spark, [(-1,), (-1,)], "label int"), "label").first()
    assert shape.clusters == 0 and shape.noise_fraction == 1.0 and shape.largest_share is None


def test_chi_square_correction_for_two_by_two(spark):
    cells = frame(spark, [("x", "u", 10), ("x", "v", 20), ("y", "u", 30), ("y", "v", 5)], "a string, b string, n long")
    total, residuals = compare.chi_square(cells)
    o = np.array([[10, 20], [30, 5]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert abs(total.first().chi2 - ((np.abs(o - e) - 0.5) ** 2 / e).sum()) < 1e-9 and residuals.count() == 4
    p = total.select(stats.chi2_tail("chi2", "dof").alias("p")).first().p
    assert abs(p - math.erfc(math.sqrt(total.first().chi2 / 2))) < 1e-10


def test_checks_raise_with_examples(spark):
    df = frame(spark, [(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for broken in (lambda: checks.unique_key(df, ["k"]), lambda: checks.known_keys(df, df.filter("k = 1"), ["k"]), lambda: checks.closed_vocabulary(df, "v", ["a"]), lambda: checks.finite_numeric(df, "k", "v"), lambda: checks.required_columns(df, ["z"]), lambda: checks.same_keys(df, df.filter("k = 1"), ["k"]), lambda: checks.one_value(df, "v"), lambda: checks.binary_values(df.select((F.col("k") * 3).alias("k")), "k")):
        with pytest.raises(ValueError):
            broken()
    with pytest.raises(Exception, match="not True or False"):
        frame(spark, [("yes",)], "v string").select(checks.strict_boolean(F.col("v"))).collect()
    got = checks.finite_numeric(frame(spark, [(1, "2.5")], "k int, v string"), "k", "v").first()
    assert got.v == 2.5


def test_admission_counts_each_row_once(spark):
    df = frame(spark, [(1, 5), (2, -1), (3, None), (4, 9)], "k int, v int")
    kept, audit = relational.admit(df, "k", [("low", F.col("v") >= 0), ("high", F.col("v") < 9)], frame(spark, [(1,), (2,), (99,)], "k int"))
    assert kept.count() == 0
    assert {(r.k, r.reason) for r in audit.collect()} == {(1, "excluded by list"), (2, "low"), (3, "low"), (4, "high")}


def test_write_rules(spark):
    rows, fresh = frame(spark, [(1, None, "a"), (2, 5, "a"), (3, 5, "b"), (4, 5, "a")], "k int, v int, d string"), frame(spark, [(1, 7), (2, 8), (3, 9), (4, 9)], "k int, v int")
    how = {"in_scope": F.col("d") == "a", "protected": F.col("k") == 4}
    append = {r.k: (r.v, r._conflict) for r in relational.write_column(rows, fresh, "k", "v", overwrite=False, **how).collect()}
    assert append == {1: (7, False), 2: (5, True), 3: (5, False), 4: (5, False)}
    assert {r.k: r.v for r in relational.write_column(rows, fresh, "k", "v", overwrite=True, **how).collect()} == {1: 7, 2: 8, 3: 5, 4: 5}


def test_merge_columns_refuses_other_keys(spark):
    a, b = frame(spark, [(1, 2), (2, 3)], "k int, v int"), frame(spark, [(1, 9), (2, 8)], "k int, v int")
    assert {r.k: r.v for r in relational.merge_columns(a, b, ["k"], ["v"]).collect()} == {1: 9, 2: 8}
    with pytest.raises(ValueError):
        relational.merge_columns(a, b.filter("k = 1"), ["k"], ["v"])


def test_sets_and_samples(spark):
    df = frame(spark, [(1, "a"), (1, "b"), (2, "a"), (3, "b")], "k int, g string")
    assert [r.k for r in relational.in_every_group(df, "k", "g").collect()] == [1]
    some, rest = relational.split_sample(df, "k", 1, [3])
    assert {r.k for r in some.collect()} == {1, 3} and {r.k for r in rest.collect()} == {2}


def test_constant_features_keep_nan_and_sparse_zeros(spark):
    nan = float("nan")
    long = frame(spark, [(1, 0, 1.0), (2, 0, 1.0), (1, 1, 1.0), (2, 1, nan), (1, 2, 4.0), (1, 3, 1.0), (2, 3, 2.0)], "k int, feature int, value double")
    assert {r.feature for r in reshape.changing_features(long, "k").collect()} == {1, 3}
    assert {r.feature for r in reshape.changing_features(long, "k", 2).collect()} == {1, 2, 3}


def test_upper_triangle_refuses_asymmetry_and_separators(spark):
    ok = frame(spark, [("a", "b", 1.0), ("b", "a", 1.0), ("a", "a", 0.0)], "i string, j string, r double")
    assert [tuple(r) for r in reshape.upper_triangle(ok, "i", "j", "r").collect()] == [("a__b", 1.0)]
    for bad in ([("a", "b", 1.0), ("b", "a", 2.0)], [("a__x", "b", 1.0), ("b", "a__x", 1.0)]):
        with pytest.raises(ValueError):
            reshape.upper_triangle(frame(spark, bad, "i string, j string, r double"), "i", "j", "r")
    masked = reshape.mask_nodes(ok, frame(spark, [("b",)], "n string"), "n", "i", "j", "r")
    assert {(r.i, r.j): r.r for r in masked.collect()} == {("a", "b"): None, ("b", "a"): None, ("a", "a"): 0.0}


@pytest.mark.parametrize("metric", ["euclidean", "czekanowski", "ruzicka"])
def test_dense_pairs_in_blocks(spark, metric):
    x = np.random.default_rng(0).random((50, 4))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    got = {(r.i, r.j): r.d for r in pairs.dense_pairs(df, "k", "v", metric, block=7).collect()}
    assert len(got) == 50 * 49 // 2
    for (i, j), d in got.items():
        u, v = x[i], x[j]
        want = {"euclidean": np.linalg.norm(u - v), "czekanowski": 1 - 2 * np.minimum(u, v).sum() / (u + v).sum(), "ruzicka": 1 - np.minimum(u, v).sum() / np.maximum(u, v).sum()}[metric]
        assert i < j and abs(d - want) < 1e-12


def test_disjoint_sets_come_back(spark):
    df = frame(spark, [(1, "x"), (2, "x"), (2, "y"), (3, "z")], "k int, f string")
    assert {(r.i, r.j): r.d for r in pairs.set_pairs(df, "k", "f", "dice", all_pairs=True).collect()} == {(1, 2): 1 - 2 / 3, (1, 3): 1.0, (2, 3): 1.0}
    assert abs(pairs.disjoint_share(df, "k", "f").first()[0] - 2 / 3) < 1e-12


def test_knn_purity_takes_the_expectation_of_ties(spark):
    p = frame(spark, [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (1, 4, 5.0), (2, 4, 5.0), (3, 4, 5.0)], "i long, j long, d double")
    got = {r.label: r for r in pairs.knn_purity(p, frame(spark, [(1, 0), (2, 0), (3, 1), (4, 1)], "key long, label int"), 1).collect()}
    assert abs(got[0].purity - 0.5) < 1e-12 and abs(got[1].purity - (0 + 1 / 3) / 2) < 1e-12 and got[0].tied_share == 1.0


def test_validity_equals_direct_formulas(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    p, lab = pairs.dense_pairs(df, "k", "v"), frame(spark, list(enumerate(y.tolist())), "key long, label long")
    got = validity.dispersion_scores(p, lab).first()
    c = np.array([x[y == k].mean(0) for k in range(3)])
    n = np.bincount(y)
    within = sum(((x[y == k] - c[k]) ** 2).sum() for k in range(3))
    ch = (n * ((c - x.mean(0)) ** 2).sum(1)).sum() / 2 / (within / 37)
    s = [np.linalg.norm(x[y == k] - c[k], axis=1).mean() for k in range(3)]
    db = np.mean([max((s[a] + s[b]) / np.linalg.norm(c[a] - c[b]) for b in range(3) if b != a) for a in range(3)])
    assert abs(got.calinski_harabasz - ch) < 1e-9 and abs(got.davies_bouldin - db) < 1e-9
    sil = validity.silhouette(frame(spark, [(1, 2, 2.0)], "i long, j long, d double"), frame(spark, [(1, 0), (2, 1)], "key long, label int"))
    assert {r.silhouette for r in sil.collect()} == {0.0}


def brute_tree(d, linkage):
    groups, out = {i: [i] for i in range(len(d))}, []
    while len(groups) > 1:
        f = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
        h, a, b = min((f(d[np.ix_(groups[a], groups[b])]), a, b) for a in groups for b in groups if a < b)
        groups[len(d) + len(out)] = groups.pop(a) + groups.pop(b)
        out.append(h)
    return out


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_merge_tree_equals_brute_force(linkage):
    x = np.random.default_rng(5).normal(size=(25, 2))
    d = cluster.distance_matrix(x)
    t = cluster.merge_tree(d, linkage)
    assert np.allclose(t[:, 2], brute_tree(d, linkage)) and t[-1, 3] == 25
    assert len(set(cluster.cut_tree(t, 4))) == 4
    if linkage == "single":
        assert np.allclose(np.sort(cluster.spanning_tree(d)[:, 2]), t[:, 2])
    assert np.isclose(cluster.cophenetic(t).max(), t[-1, 2])


def test_matrix_methods_find_blobs(spark):
    rng = np.random.default_rng(6)
    truth = np.repeat(range(3), 20)
    x = np.array([[0, 0], [8, 0], [0, 8]])[truth] + rng.normal(0, 0.3, (60, 2))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    for method, params in (("hac", {"k": 3, "linkage": "ward"}), ("hdbscan", {"least_size": 5}), ("adp", {"z": 1.6}), ("spectral", {"k": 3})):
        got = [r.label for r in cluster.cluster_groups(df, None, "k", "v", method, **params).orderBy("key").collect()]
        keep = [g for g in got if g != -1]
        assert len(set(keep)) == 3 and len(keep) > 50, method
        assert all(len({g for g, t in zip(got, truth, strict=True) if t == k and g != -1}) == 1 for k in range(3)), method
    labels, inertia = cluster.kmeans(df, "k", "v", 3, seed=1)
    assert labels.select("label").distinct().count() == 3 and inertia["inertia"] > 0
    assert 0.5 < cluster.dbcv(cluster.distance_matrix(x), truth, 2) <= 1
    assert cluster.dbcv(cluster.distance_matrix(x), np.zeros(60, int), 2) is None


def test_tree_tables(spark):
    df = frame(spark, [(i, [float(v)]) for i, v in enumerate([0, 1, 10, 11, 50])], "k long, v array<double>")
    t = tree.linkage_table(df, "k", "v", "single")
    assert [r.height for r in t.orderBy("merge").collect()] == [1.0, 1.0, 9.0, 39.0]
    assert {r.k: r.jump for r in tree.jumps(t, 5).collect()} == {4: 1.0, 3: 9.0, 2: 39 / 9}
    assert {r.k: r.cut for r in tree.cut_heights(t, 5).collect()}[2] == 24.0
    assert tree.splits(t, 5).count() == 4 and tree.cophenetic_correlation(df, "k", "v").first().correlation > 0.5


def test_pca_varimax_and_t_maps(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    p = reduce.Pca(df, "v")
    assert np.allclose(p.values, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    scores = p.scores(df, ["k"], "v", 2)
    s = np.array([r.scores for r in scores.orderBy("k").collect()])
    assert np.allclose(np.abs(s), np.abs((x - x.mean(0)) @ p.vectors[:, :2]))
    r = reduce.varimax(p.loadings(3))
    assert np.allclose(r.T @ r, np.eye(3))
    long = df.select("k", F.posexplode("v").alias("feature", "value"))
    t = {r.feature: r.t for r in reduce.component_t_maps(long, scores, "k", "feature", "value", 2).collect()}
    design = np.column_stack([np.ones(80), s])
    inv = np.linalg.inv(design.T @ design)
    for f in range(5):
        b = inv @ design.T @ x[:, f]
        se = np.sqrt(((x[:, f] - design @ b) ** 2).sum() / 77 * np.diag(inv))
        assert np.allclose(t[f], (b / se)[1:])
    with pytest.raises(ValueError):
        reduce.Pca(df.withColumn("v", F.array(F.lit(1.0), F.get("v", 0))), "v", standardize=True)
    pdf = pairs.dense_pairs(df, "k", "v").toPandas()
    m = reduce.classical_mds(pdf, 5).set_index("id")[[f"dim{i}" for i in range(5)]].to_numpy()
    assert np.allclose(cluster.distance_matrix(m), cluster.distance_matrix(x), atol=1e-6)


def test_statistics(spark):
    df = frame(spark, [("a", v) for v in (1.0, 2.0, 2.0, 5.0, 9.0)] + [("b", v) for v in (2.0, 3.0, 3.0, 7.0)] + [("c", 1.0)], "g string, v double")
    u = sum((x > y) + 0.5 * (x == y) for x in (1, 2, 2, 5, 9) for y in (2, 3, 3, 7))
    got = stats.mann_whitney(df, "g", "a", "b", "v").first()
    assert got.u == u and abs(got.r - (2 * u / 20 - 1)) < 1e-12 and stats.mann_whitney(df, "g", "a", "c", "v").first().u is None
    p = [0.01, 0.04, 0.03, 0.9]
    adj = {r.k: r.p_adjusted for r in stats.benjamini_hochberg(frame(spark, list(enumerate(p)), "k int, p double"), "k", "p").collect()}
    assert [round(adj[i], 6) for i in range(4)] == [0.04, 0.053333, 0.053333, 0.9]
    assert abs(stats._fisher(8, 2, 1, 5) - 0.03496503) < 1e-6
    w = stats.wilcoxon_signed(frame(spark, [(3.0, 1.0), (1.0, 2.0), (5.0, 5.0), (7.0, 2.0)], "a double, b double"), "a", "b").first()
    assert (w.n, w.w_plus, w.w_minus) == (3, 5.0, 1.0)
    tests = {r.category: r for r in stats.category_tests(frame(spark, [("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] + [("b", "y")] * 5, "g string, c string"), "g", "a", "b", "c").collect()}
    assert tests["x"].odds_ratio == 20.0 and abs(tests["x"].p - 0.03496503) < 1e-6


def test_logistic_recovers_and_guards(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, 2))
    y = rng.random(800) < 1 / (1 + np.exp(-(0.5 + 1.2 * x[:, 0])))
    df = frame(spark, [(int(b), float(u), float(v)) for b, (u, v) in zip(y, x, strict=True)], "y int, u double, v double")
    got = {r.term: r for r in stats.logistic_vs_rest(df, "y", ["u", "v"]).collect()}
    assert abs(got["u"].coefficient - 1.2) < 0.3 and got["u"].p < 1e-6 and got["v"].p > 0.001 and got["u"].low < got["u"].odds_ratio < got["u"].high
    assert {r.note for r in stats.logistic_vs_rest(df.limit(12), "y", ["u", "v"]).collect()} == {"fewer than 10 events a term"}


def test_sweeps(spark):
    grid = sweep.combo_grid(spark, {"k": [2, 3], "m": ["a", "b"]})
    assert {r.combo_key for r in grid.collect()} == {"k=2,m=a", "k=2,m=b", "k=3,m=a", "k=3,m=b"}
    assert grid.select(S.parse_combo_key(F.col("combo_key")).alias("p")).filter("p['k'] = '2'").count() == 2
    with pytest.raises(ValueError):
        sweep.combo_grid(spark, {"k": [1, 1]})
    assert sweep.one_axis_slices(grid, {"k": 2, "m": "a"}, ["k", "m"]).count() == 4
    assert sweep.missing_combos(grid, grid.limit(3)).count() == 1
    labels = frame(spark, [(z, i, lab) for z, labs in ((1, [0, 0, 1, 1]), (2, [5, 5, 6, 6]), (3, [0, 1, 0, 1])) for i, lab in enumerate(labs)], "z int, k int, l int").withColumn("g", F.lit("x"))
    assert {r.z: round(r.ari, 6) for r in sweep.ari_against_previous(labels, ["g"], "z", "k", "l").collect()} == {2: 1.0, 3: -0.5}
    assert sweep.largest_share(labels, "z", "l").filter("largest_share = 0.5").count() == 3


def test_stability(spark):
    runs = frame(spark, [(r, i, lab) for r, labs in enumerate([[0, 0, 1], [2, 2, 2], [0, 1, 1]]) for i, lab in enumerate(labs)], "r int, k int, l int")
    pairs_ = stability.cooccurrence(runs, "r", "k", "l")
    assert {(p.i, p.j): round(p.share, 3) for p in pairs_.collect()} == {(0, 1): 0.667, (0, 2): 0.333, (1, 2): 0.667}
    assert stability.ambiguity(pairs_).first().stability == 0.0 and stability.monti(pairs_, 3).count() == 3
    with pytest.raises(ValueError):
        stability.monti(pairs_, 4)


def test_grids(spark):
    a = np.diag([2.0, 2, 2, 1])
    flip = a.copy()
    flip[0] = [-2, 0, 0, 6]
    assert spatial.is_voxel_map(a, flip) and not spatial.is_voxel_map(a, np.diag([1.0, 1, 1, 1]) * 3) and spatial.needs_resample((4, 4, 4), a, (4, 4, 4), flip)
    vox = frame(spark, [("s", i, 0, 0, float(i)) for i in range(4)], "subject string, i long, j long, k long, value double")
    assert {r.i: r.value for r in spatial.resample_nearest(vox, a, (4, 1, 1), flip).collect()} == {0: 3.0, 1: 2.0, 2: 1.0, 3: 0.0}
    center = a.copy()
    center[0, 3] = -3
    m = spatial.lesion_metrics(spatial.binarize(vox, 0.5), center, vox.filter("i < 3")).first()
    assert (m.volume, m.left, m.right) == (2, 1, 1) and abs(m.out_of_brain_fraction - 1 / 3) < 1e-12


def test_scalars(spark):
    df = frame(spark, [(-1, 0.0, "n/a", "sub-STUCL01", 1234567.891), (3, 0.5, " x ", "ST_UCL-02", 2.0)], "l int, v double, t string, s string, n double")
    r = df.select(S.cluster_name(F.col("l")).alias("a"), S.missing_to_null(F.col("t")).alias("b"), S.canonical_id(F.col("s")).alias("c"), S.comma_number(F.col("n"), 1).alias("d"), S.plain_number(F.col("n")).alias("e"), S.reading_level(F.col("v"), [0.2, 0.5], ["low", "mid", "high"]).alias("f"), S.side_of(F.col("v"), 0.1).alias("g")).collect()
    assert tuple(r[0]) == ("noise", None, "sub-STUCL01", "1.234.567,9", "1234567.891", "low", "both")
    assert tuple(r[1]) == ("3", "x", "sub-STUCL02", "2,0", "2", "high", "left")
    with pytest.raises(Exception, match="malformed"):
        df.select(S.group_of(F.col("s"), "^sub-([A-Z]{2})", {"ST": "stroke"})).collect()
    assert describe.own_membership("l", "m") is not None


def test_sources_and_artifacts(spark, tmp_path):
    (tmp_path / "r.csv").write_text("subject_id,original_id,dataset,has_lesion,has_sdc,has_features\nNA,1,d,True,False,True\n007,2,d,True,True,True\n")
    assert {(r.subject_id, r.has_sdc) for r in tables.registry(spark, str(tmp_path / "r.csv")).collect()} == {("NA", False), ("007", True)}
    (tmp_path / "m.csv").write_text("subject_id,a,b\n1,2.5,n/a\n2,,NaN\n")
    assert tables.measurements(spark, str(tmp_path / "m.csv")).filter("value is not null").count() == 1
    (tmp_path / "x.csv").write_text("subject_id,dataset,reason,scope,value\n1,d,bad,all,\n1,d,bad,one,\n")
    with pytest.raises(ValueError, match="scope all"):
        tables.exclusions(spark, str(tmp_path / "x.csv"), ["bad"], ["one"])
    for s in "ab":
        (tmp_path / "v").mkdir(exist_ok=True)
        (tmp_path / "v" / f"{s}_tracts.csv").write_text("tract,ratio\nt1,0.5\n" + ("t2,0.1\n" if s == "a" else ""))
    paths = tables.files_by_subject(spark, f"file://{tmp_path}/v", "*_tracts.csv")
    keys = frame(spark, [("t1",), ("t2",)], "tract string")
    assert {(r.subject, r.tract): r.ratio for r in tables.keyed_values(spark, paths, keys, "tract", "ratio").collect()}[("b", "t2")] == 0.0
    with pytest.raises(ValueError, match="missing"):
        tables.keyed_values(spark, paths, keys, "tract", "ratio", missing="refuse")
    with pytest.raises(ValueError, match="unknown"):
        tables.keyed_values(spark, paths, keys.limit(1), "tract", "ratio")
    folder = f"file://{tmp_path}/run"
    artifacts.save(spark, folder, {"matrix": keys}, {"k": 2})
    assert artifacts.load(spark, folder, "matrix").count() == 2 and artifacts.config(spark, folder) == {"k": 2}
    with pytest.raises(ValueError, match="exists"):
        artifacts.save(spark, folder, {"matrix": keys}, {})
    artifacts.save(spark, folder, {"matrix": keys.limit(1)}, {}, overwrite=True)
    assert artifacts.load(spark, folder, "matrix").count() == 1
    for i in range(2):
        artifacts.append_log(spark, f"file://{tmp_path}/log", f"r{i}", "tuning", {"k": i}, folder)
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2
    assert tables.config_block("# t\n## Config\n```json\n{\"a\": 1}\n```\n") == {"a": 1} and tables.params_line("- Params used: {\"k\": 3}") == {"k": 3}
    assert tables.text_sections("## hint: a\nx\ny\n## list: b\n- p\n- q\n", ["hint: a", "list: b"], ["list"]) == {"hint: a": "x y", "list: b": ("p", "q")}
