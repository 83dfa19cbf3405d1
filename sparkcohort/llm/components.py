"""Connected components of an edge table.

A table of few edges goes to one task with a union-find; a larger one through alternating large-star and small-star
steps, each a few joins and aggregates. Both give the same table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.shared import cut, forget


#: Edges that go to one task at most (about 100 MB there).
ONE_TASK = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    top: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while top[root] != root:
            root = top[root]
        while top[x] != root:
            top[x], x = root, top[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for v in (a, b):
                top.setdefault(v, v)
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    nodes = list(top)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["node", "label"])


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b. Minima by aggregation, so no neighbour list is gathered."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("at", "low").alias("low"))
    large = both.join(lowest, F.col("a") == F.col("at")).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "at")
    joined = large.join(least, F.col("a") == F.col("at"))
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").unionByName(joined.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node, label (the smallest node it reaches) of every node with an edge. Nulls and loops join nothing; an empty table gives no rows.
    edges is read more than once, so it should be a written table.

    The table is written to the shared folder after each step, so a lost executor costs one step. It stops when a step
    changes nothing: then every node hangs from its component's smallest.
    """
    now = edges.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b")).filter("a <> b")
    if now.count() <= one_task:
        return now.coalesce(1).mapInArrow(_union_find, "node long, label long")
    now = cut(now.distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(most):
        new = cut(_star(now), "edges")
        now, old = new, now
        after = mark(new)
        forget(old)
        if after == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        seen = after
    raise RuntimeError(f"components have not settled in {most} steps")
