import zlib

import numpy as np

from sparkcohort.llm.crf import chances, document_features, fit, score_documents, windows, with_neighbours


def brute_marginals(u, stay):
    n = len(u)
    total, good = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        s = sum(x for x, v in zip(u, y, strict=True) if v) + sum((stay[0] if a else stay[1]) for a, b in zip(y, y[1:]) if a == b)
        w = np.exp(s)
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    for n in range(1, 9):
        u, stay = rng.normal(size=n).tolist(), (0.7, -0.3)
        assert np.allclose(chances(u, stay), brute_marginals(u, stay))


def test_fit_separates():
    rng = np.random.default_rng(1)
    docs = [with_neighbours(np.column_stack([np.ones(5), rng.normal(3 * (i % 2) - 1.5, 1, 5)]), np.arange(5) == 0) for i in range(60)]
    w, stay = fit(docs, [i % 2 for i in range(60)])
    right = [(np.mean(chances((d @ w).tolist(), stay)) >= 0.5) == bool(i % 2) for i, d in enumerate(docs)]
    assert np.mean(right) > 0.95


def test_held_out_accuracy_and_fold(documents, labels):
    rows = score_documents(documents, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    seen = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(seen) > 50 and np.mean(seen) > 0.95


def test_held_out_labels_change_nothing(documents, labels, spark):
    from pyspark.sql import functions as F

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    twisted = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in score_documents(documents, labels).collect()}
    assert a == {r.doc_id: r.score for r in score_documents(documents, twisted).collect()}


def test_edges(edges, labels, spark):
    rows = score_documents(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in score_documents(edges, labels.limit(0)).collect()} == {0.5}
    assert score_documents(edges.limit(0), labels).count() == 0
    kept = score_documents(edges, labels, carry=["lang", "key"])
    assert kept.columns == ["lang", "key", "doc_id", "held_out", "score", "predicted"]
    assert document_features(b"")[0].shape[0] == 1


def test_windows_spread_over_the_text():
    assert windows(10, 64) == [(0, 10)]
    assert windows(1000, 64) == [(0, 16), (328, 344), (656, 672), (984, 1000)]
    assert windows(3, 1) == [(0, 1), (1, 2), (2, 3)]


def test_junk_after_a_good_head_counts(documents, labels, spark):
    good = [r.text for r in documents.join(labels, "doc_id").filter("quality = 1").orderBy("doc_id").limit(8).collect()]
    junk = [r.text for r in documents.join(labels, "doc_id").filter("quality = 0").orderBy("doc_id").limit(8).collect()]
    halves = []
    for g, j in zip(good, junk):
        many = max(1, len(g) // max(1, len(j)))
        halves.append(g + "\n" + "\n".join([j] * many))
    docs = spark.createDataFrame(list(enumerate(good + junk + halves)), "doc_id long, text string")
    mixed = documents.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 1000000000 AS doc_id", "text"))
    by = {r.doc_id - 1000000000: r.score for r in score_documents(mixed, labels).filter("doc_id >= 1000000000").collect()}
    assert np.mean([by[i] for i in range(8)]) > 0.9 and np.mean([by[8 + i] for i in range(8)]) < 0.1
    assert all(min(by[i], by[8 + i]) - 0.05 <= by[16 + i] <= max(by[i], by[8 + i]) + 0.05 for i in range(8))
    assert 0.1 < np.mean([by[16 + i] for i in range(8)]) < 0.9


def test_several_texts_of_one_id_teach_once(spark, documents, labels):
    twice = documents.unionByName(documents)
    a = {r.doc_id: r.score for r in score_documents(documents, labels).collect()}
    assert a == {r.doc_id: r.score for r in score_documents(twice, labels).collect()}
