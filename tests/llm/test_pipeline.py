from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from sparkcohort.llm.linededup import dedup_lines
from sparkcohort.llm.ngram import ngram_groups
from sparkcohort.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, documents, labels):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DIR).cache()
        kept[name] = (before, docs)
        if name != names[-1]:
            assert docs.columns == corpus_pipeline.COLUMNS
    quality = {r.doc_id: r.quality for r in labels.collect()}
    left = {r.doc_id for r in kept[names[0]][1].collect()}
    told = [(d in left) == (q == 1) for d, q in quality.items()]
    assert sum(told) > 0.97 * len(told)
    before, after = kept[names[1]]
    want = {r.doc_id: r.text for r in dedup_lines(before).collect() if not (r.n_removed and not r.words_left)}
    assert want == {r.doc_id: r.text for r in after.collect()}
    before, after = kept[names[2]]
    groups = {r.component_id for r in ngram_groups(before).collect()}
    assert groups == {r.doc_id for r in after.collect()} and after.count() == len(groups)
    before, after = kept[names[3]]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()} and after.count() > before.count()
    before, after = kept[names[4]]
    assert sum(r.length for r in after.filter("start = 0").collect()) <= sum(r.length for r in after.collect())
    assert after.filter("start = 0").count() == before.count()


def test_empty_tables(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0


def test_nulls_ties_long_texts_and_clashing_columns(spark, edges):
    docs, ids = edges, Counter(r.doc_id for r in edges.collect())
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DIR).cache()
        left = Counter(r.doc_id for r in after.select("doc_id").distinct().collect())
        assert set(left) <= set(ids), name
        ids, docs = left, after
    alone = {name: stage(spark, edges, DIR) for name, stage in corpus_pipeline.STAGES[1:]}
    kept = [r.doc_id for r in alone["n-gram Jaccard join"].collect()]
    assert kept.count(5) == 1 and 7 not in kept and 11 not in kept and {1, 2, 3, 6, 8, 9, 10} <= set(kept)
    deduped = {r.doc_id: r.text for r in alone["line dedup"].filter("doc_id is not null").collect()}
    assert 7 not in deduped and deduped[1] is None and deduped[2] == ""
    tokens = alone["packing"].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in tokens} == set(r.doc_id for r in edges.collect())


def test_run_equals_stages(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
    totals = lambda df: {(r.doc_id, r.doc_tokens): (r.n, r.copies) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("copies")).collect()}
    want, got = totals(docs), totals(corpus_pipeline.run(spark, small))
    assert got == want and len(got) > 100 and all(n == copies * t for (_, t), (n, copies) in got.items())


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES)
