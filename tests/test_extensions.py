import gzip
import struct

import numpy as np
import pytest

from sparkcohort.operators import embed, pairs, prediction, stability, tree
from sparkcohort.plans import evaluations
from sparkcohort.sources import images


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def blobs(spark, n=20, seed=6):
    rng = np.random.default_rng(seed)
    truth = np.repeat(range(3), n)
    x = np.array([[0, 0, 0], [8, 0, 1], [0, 8, 2]])[truth] + rng.normal(0, 0.3, (3 * n, 3))
    return frame(spark, [(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, truth, strict=True))], "k long, v array<double>, t int"), x, truth


def nifti(values, affine):
    head = bytearray(352)
    head[0:4] = struct.pack("<i", 348)
    head[40:56] = struct.pack("<8h", 3, *values.shape, 1, 1, 1, 1)
    head[70:72] = struct.pack("<h", 16)
    head[108:120] = struct.pack("<3f", 352, 2.0, 1.0)
    head[252:256] = struct.pack("<2h", 0, 1)
    head[280:328] = struct.pack("<12f", *affine[:3].ravel())
    return gzip.compress(bytes(head) + values.astype("<f4").tobytes(order="F"))


def test_images(spark, tmp_path):
    v = np.zeros((2, 3, 4), "f4")
    v[1, 2, 3] = 5
    affine = np.diag([2.0, 2, 2, 1])
    (tmp_path / "a.nii.gz").write_bytes(nifti(v, affine))
    paths = frame(spark, [("a", f"file:{tmp_path}/a.nii.gz")], "subject string, path string")
    rows = images.voxels(spark, paths).collect()
    assert len(rows) == 24 and {(r.i, r.j, r.k): r.value for r in rows}[(1, 2, 3)] == 11.0 and rows[0].affine[0] == 2.0
    with pytest.raises(ValueError):
        images.decode_nifti(b"x" * 400)
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(2, 3))
    assert [r.x for r in images.matrix_rows(spark, f"{tmp_path}/m.npy").orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "l.xml").write_text('<atlas><data><label index="0">Left</label><label index="4"> Right</label></data></atlas>')
    assert {(r["index"], r["name"]) for r in images.xml_labels(spark, f"{tmp_path}/l.xml").collect()} == {(1, "Left"), (5, "Right")}


def test_embeddings(spark):
    df, x, truth = blobs(spark)
    pca = embed.embed(df, "k", "v", "pca", n_components=2)
    assert embed.trustworthiness(df, "k", "v", pca, "scores", 5).first()[0] > 0.9
    same = embed.trustworthiness(df, "k", "v", df.selectExpr("k", "v as scores"), "scores", 5).first()[0]
    assert same == 1.0
    t = np.array([r.scores for r in embed.embed(df, "k", "v", "tsne", rounds=200, perplexity=8).orderBy("k").collect()])
    centers = np.array([t[truth == c].mean(0) for c in range(3)])
    assert (((t[:, None] - centers) ** 2).sum(2).argmin(1) == truth).mean() > 0.95
    for bad in (lambda: embed.embed(df, "k", "v", "umap"), lambda: embed.pca_embedding(df, "k", "v"), lambda: embed.trustworthiness(df, "k", "v", pca, "scores", 40)):
        with pytest.raises(ValueError):
            bad()


def test_prediction(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(25, 3))
    y = x @ np.array([1.0, -2, 0]) + rng.normal(0, 0.1, 25)
    p = prediction.ridge_leave_one_out(spark, x, y, [0.01, 1.0, 100.0])
    assert p.count() == 25 and prediction.accuracy(p).first().r2 > 0.95
    i, lam = 3, 1.0
    errors = prediction._loo_errors(x, y, lam)
    keep = np.arange(25) != i
    assert abs(errors[i] - (y[i] - prediction.nested_prediction(x, y, [lam], i)[0])) < 1e-9 and keep.sum() == 24
    got = prediction.permutation_p(spark, x[:12], y[:12], [1.0], 19).first()
    assert got.p <= 0.15


def test_repeats_and_evaluations(spark):
    df, x, truth = blobs(spark, 8)
    runs = stability.repeated_labels(df, "k", "v", "hac", 3, share=0.8, k=3)
    c = stability.cooccurrence(runs, "run", "k", "label")
    assert stability.ambiguity(c).first().stability == 1.0
    assert stability.subsampling_stability(df, "k", "v", "hac", 0.8, k=3).first().ari == 1.0
    assert stability.eigengap(stability.cooccurrence(stability.repeated_labels(df, "k", "v", "kmeans", 2, k=3), "run", "k", "label"), 3) > 0.5
    assert stability.stability_sweep(df, "k", "v", [2, 3], 2).count() == 2
    p = pairs.dense_pairs(df, "k", "v")
    labels = df.selectExpr("k as key", "t as label")
    got = {r.metric: r for r in evaluations.evaluate(p, labels, ["silhouette", "dispersion", "dunn"]).collect()}
    assert got["silhouette"].value > 0.8 and got["dunn"].value > 1 and got["clusters"].value == 3
    one = {r.metric: r for r in evaluations.evaluate(p, labels.selectExpr("key", "0 as label"), ["silhouette"]).collect()}
    assert one["silhouette"].value is None and one["silhouette"].note
    odd = {r.metric: r.note for r in evaluations.evaluate(p, labels, ["dunn"], metric="dice").collect()}
    assert "euclidean" in odd["dunn"]
    combos = labels.selectExpr("'a' as c", "key", "label").unionByName(labels.selectExpr("'b' as c", "key", "case when label = 2 then -1 else 0 end as label"))
    table = {r.c: r for r in evaluations.evaluate_sweep(p, combos, "c").collect()}
    assert abs(table["a"].silhouette - got["silhouette"].value) < 1e-12 and table["b"].silhouette is None and abs(table["b"].noise_fraction - 1 / 3) < 1e-12
    assert evaluations.best(evaluations.evaluate_sweep(p, combos, "c"), "silhouette", ties=["c"]).first().c == "a"
    runs = frame(spark, [("r1", "x", "hac", "{}"), ("r2", "y", "hac", "{}"), ("r3", "y", "gmm", "{}")], "run_id string, modality string, method string, params string")
    assert [r.run_id for r in evaluations.compatible_runs(runs, "r1").collect()] == ["r2"]
    assert evaluations.incompatibility({"modality": "x", "method": "a", "params": 1}, {"modality": "y", "method": "a", "params": 2}) == "other parameters"


def test_tree_cuts(spark):
    df, x, truth = blobs(spark, 5)
    t = tree.linkage_table(df, "k", "v", "average").toPandas()
    cuts = tree.labels_of_cuts(t, [2, 3])
    assert tree.reproduces(t, cuts) and not tree.reproduces(t, cuts.assign(label=lambda d: d["leaf"] % d["k"]))
    assert tree.truncated_leaves(t, 3).groupby("group").size().tolist() == [5, 5, 5]


def test_small_helpers(spark):
    from sparkcohort.operators import cluster, describe, reduce, relational

    df, x, truth = blobs(spark, 10)
    assert cluster.affinity(cluster.distance_matrix(x)).max() == 1.0
    for kind, k in (("knn", 5), ("self_tuning", 5)):
        values = cluster.smallest_eigenvalues(cluster.affinity(cluster.distance_matrix(x), kind, k), 8)
        assert cluster.largest_gap(values) == 3, kind
    p = reduce.Pca(df, "v")
    r = reduce.varimax(p.loadings(2))
    assert abs(reduce.rotated_shares(p, 2, r).sum() - p.shares()[:2].sum()) < 1e-9
    maps = frame(spark, [(f, [float(f), float(-f)]) for f in range(5)], "f int, t array<double>")
    assert {m.component: round(m.correlation, 9) for m in reduce.map_reproducibility(maps, maps.selectExpr("f", "array(t[1], t[1]) as t"), "f").collect()} == {0: -1.0, 1: 1.0}
    v = frame(spark, [("b",), ("z",), ("a",), ("a",)], "v string")
    assert [w["value"] for w in describe.ordered_values(v, "v", ["z"]).orderBy("place").collect()] == ["z", "a", "b"]
    assert describe.representative_values(frame(spark, [(2,), (9,), (4,), (4,)], "v int"), "v").first()["values"] == [2, 4, 9]
    rows, table = frame(spark, [(1,), (2,), (3,)], "k int"), frame(spark, [(1, "x"), (2, " ")], "k int, c string")
    assert {q.k: q.c for q in relational.lookup(rows, table, "k", "c").collect()} == {1: "x", 2: "unknown", 3: "unknown"}


def test_artifacts_replace_whole_and_sections_are_given_once(spark, tmp_path):
    import pytest

    from sparkcohort.sources import artifacts, tables

    folder = f"file://{tmp_path}/run"
    artifacts.save(spark, folder, {"t": spark.range(2)}, {"v": 1})
    artifacts.save(spark, folder, {"t": spark.range(5)}, {"v": 2}, overwrite=True)
    assert artifacts.load(spark, folder, "t").count() == 5 and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["run"]
    with pytest.raises(ValueError):
        artifacts.save(spark, folder, {"t": spark.range(5)}, {"v": 2})
    assert tables.text_sections("## a: x\nsome\ntext\n", ["a: x"]) == {"a: x": "some text"}
    for text in ("## a: x\none\n## a: x\ntwo\n", "## a: x\n\n"):
        with pytest.raises(ValueError):
            tables.text_sections(text, ["a: x"])


def test_dual_axes_of_many_rows_equal_those_of_their_products(spark, monkeypatch):
    import numpy as np

    from sparkcohort.operators import pairs, reduce

    x = np.random.default_rng(2).normal(size=(40, 6)) * [5, 4, 3, 2, 1, 0]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key long, x array<double>")
    dual = reduce.DualPca(pairs.dense_pairs(rows, "key", "x").toPandas(), 6)
    few = reduce.DualPca.of_rows(rows.limit(4), "key", "x", 6)
    assert isinstance(few, reduce.DualPca) and few.kept == 3
    monkeypatch.setattr(pairs, "dense_pairs", None)
    axes = reduce.DualPca.of_rows(rows, "key", "x", 6)
    assert axes.kept == dual.kept == 5 and np.allclose(axes.values, dual.values)
    got = np.array([r["scores"] for r in axes.scores(rows, "key", "x").orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(dual.coordinates.sort_values("id").drop(columns="id").to_numpy()))
