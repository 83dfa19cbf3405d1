import random
from collections import defaultdict

from sparkcohort.llm.mixing import mix_sources, mixed_documents


def words(t):
    return len((t or "").encode().split())


def water_fill(sizes, weights, share):
    """Targets by resharing the excess until none is above."""
    cap = {s: 2 * n for s, n in sizes.items()}
    left, free, out = share * sum(sizes.values()), dict(weights), {}
    while free:
        unit = left / sum(free.values())
        over = [s for s in free if free[s] * unit >= cap[s]]
        if not over:
            out |= {s: w * unit for s, w in free.items()}
            break
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
            del free[s]
    return out


def check(rows, docs):
    sizes, most, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, s in docs:
        sizes[s] += words(t)
        most[s] = max(most[s], words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        low = int(r["target"] / r["source_size"] + 1e-9) if r["source_size"] else 0
        assert r["copies"] in ((low, low + 1) if r["size"] else (0, low))
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6, s


def test_targets_and_copies(spark, documents):
    rows = mix_sources(documents).collect()
    check(rows, [(r.doc_id, r.text, r.source) for r in documents.collect()])


def test_edge_rows_and_reruns(edges, edge_rows):
    rows = mix_sources(edges).collect()
    check(rows, edge_rows)
    again = mix_sources(edges.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_hot_source_and_repeated_rows(spark):
    rng = random.Random(3)
    docs = [(i, "w " * rng.randint(1, 60), "hot" if rng.random() < 0.8 else rng.choice("xyz")) for i in range(3000)] + [(None, "same words here", "hot")] * 700
    rows = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    check(rows, docs)


def test_mixed_documents_are_the_copies(spark, documents, edges):
    for docs in (documents, edges):
        want = sum(r["copies"] for r in mix_sources(docs).collect())
        out = mixed_documents(docs)
        assert out.columns == docs.columns and out.count() == want


def test_empty(spark, edges):
    assert mix_sources(edges.limit(0)).count() == 0
    assert mixed_documents(edges.limit(0)).count() == 0
