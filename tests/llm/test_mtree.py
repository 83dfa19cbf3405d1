import math

import numpy as np

from sparkcohort.llm import mtree
from sparkcohort.llm.mtree import MTree, top_k


def brute(rows, k=20):
    v = [(i, tuple(math.floor(64 * float(np.float32(c))) for c in x)) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for q, x in sorted(set(v)):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in v if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, x, 0, 0) for i, x in rows], "vec_id long, embedding array<float>, key int, score int")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, **how).collect())


def test_ties_copies_nulls_and_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(400)]
    same = rng.normal(size=6).astype("float32").tolist()
    rows += [(1000 + i, same) for i in range(300)] + [(2000, [0.0] * 6), (2001, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2020, [float("inf")] * 6), (None, same)]
    for how in ({}, {"block": 100, "query_block": 7, "page": 8, "fanout": 4}):
        assert run(spark, rows, **how) == brute(rows)


def test_repeated_rows_count_each(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(50)] * 2 + [(20, [0.5, -1.0]), (3, [6.0, 6.0])]
    for how in ({}, {"block": 16, "query_block": 2, "page": 4, "fanout": 3, "k": 5}):
        assert run(spark, rows, **how) == brute(rows, how.get("k", 20))


def test_far_cells_are_not_visited(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 10)) * 8
    x = centers[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 10)) / 50
    x /= np.linalg.norm(x, axis=1)[:, None] / 8
    rows = [(i, r.astype("float32").tolist()) for i, r in enumerate(x)]
    asked: list[int] = []
    inner = mtree.dealt

    def counted(table, asks, *how):
        asked.append(asks.count())
        return inner(table, asks, *how)

    mtree.dealt = counted
    try:
        assert run(spark, rows, block=100, page=16) == brute(rows)
    finally:
        mtree.dealt = inner
    assert asked[0] == 75 and asked[1] < 0.3 * 75 * 15  # of 15 blocks or more


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5])]) == [(0, 1, 1, 64 * 32 + 128 * 32)]
    assert run(spark, []) == [] and run(spark, [(20, [1.0])]) == []


def test_huge_components_are_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 3.0]), (3, [1e6, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_bounds_save_distances():
    rng = np.random.default_rng(3)
    centers = rng.integers(-400, 400, (30, 16))
    x = (centers[rng.integers(0, 30, 6000)] + rng.integers(-4, 5, (6000, 16))).astype(float)
    tree, count = MTree(x, np.arange(6000), page=64), np.zeros(1)
    for q in range(0, 100, 20):
        scores, ids = tree.search(x[q], q, 10, count)
        want = sorted((-float(x[q] @ x[c]), c) for c in range(6000) if c != q)[:10]
        assert [(-s, c) for s, c in zip(scores, ids, strict=True)] == want
    assert count[0] < 0.7 * 5 * 6000
