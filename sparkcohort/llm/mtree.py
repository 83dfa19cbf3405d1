"""Exact top-k search by inner product with M-trees.

With one more component, sqrt(M^2 - |x|^2), all vectors lie on a sphere of radius M and the order by inner product
becomes the order by Euclidean distance, which is a metric. The top of the tree is one page of pivots: each row goes to
the cell of its nearest pivot, whose covering radius is kept, and large cells are cut into blocks. Each block's M-tree
(pages with routing objects, covering radii and distances to the parent) answers queries best-first. A query first
searches one block of its own cell; the k-th score found there bounds the cells that it visits next, by distance to
their pivots less their radii, and the pages within them. The best of all are merged. Scores are exact integers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.llm.shared import cut, forget

EXACT = 2.0**53
LONG = 2**63 - 1


class Page:
    """A node. Inner: routing objects of its children, their covering radii and distances to this node's own routing object.
    Leaf: its entries instead, with their distances to it."""

    __slots__ = ("children", "ids", "points", "radius", "smallest", "to_parent", "vectors")


class MTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, page: int = 1024, fanout: int = 32, top: float | None = None) -> None:
        """top: M^2, at least the largest squared norm (None: that of vectors)."""
        norms = (vectors * vectors).sum(1)
        self.top = float(norms.max(initial=0)) if top is None else top
        self.vectors, self.ids, self.page, self.fanout = vectors, ids, page, fanout
        self.largest = float(np.abs(vectors).max(initial=0))
        #: Integers whose products and sums stay below 2^24 are exact in single precision too.
        self.kind = np.float32 if self.largest**2 * max(1, vectors.shape[1]) < 2**24 else np.float64
        self.points = np.column_stack([vectors, np.sqrt(np.maximum(self.top - norms, 0))])
        self.root = self._build(np.arange(len(ids)), None)

    def _build(self, rows: np.ndarray, center: np.ndarray | None) -> Page:
        p = Page()
        p.smallest = int(self.ids[rows].min()) if len(rows) else LONG
        own = self.points[rows]
        far = np.zeros(len(rows)) if center is None else np.linalg.norm(own - center, axis=1)
        if len(rows) <= self.page:
            p.children, p.vectors, p.ids, p.points, p.to_parent, p.radius = None, self.vectors[rows].astype(self.kind), self.ids[rows], None, far, None
            return p
        many = min(self.fanout, -(-len(rows) // (self.page // 2)))
        pivots = np.unique(own[np.linspace(0, len(rows) - 1, many).astype(int)], axis=0)
        squares = (own * own).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * own @ pivots.T
        nearest = squares.argmin(1)
        kids, radii = [], []
        for i, pivot in enumerate(pivots):
            mine = rows[nearest == i]
            if len(mine) == len(rows) or len(mine) > 0.9 * len(rows) and not np.ptp(self.points[mine], axis=0).any():
                # one vector many times: pages of equal entries, in the order of ids
                mine = mine[np.argsort(self.ids[mine], kind="stable")]
                parts = np.array_split(mine, -(-len(mine) // self.page))
            else:
                parts = [mine] if len(mine) else []
            for part in parts:
                kids.append((pivot, part))
        p.children, p.vectors, p.ids = [self._build(part, pivot) for pivot, part in kids], None, None
        p.points = np.array([pivot for pivot, _ in kids])
        for pivot, part in kids:
            radii.append(np.linalg.norm(self.points[part] - pivot, axis=1).max())
        p.radius = np.array(radii)
        p.to_parent = np.zeros(len(kids)) if center is None else np.linalg.norm(p.points - center, axis=1)
        return p

    def search(self, query: np.ndarray, own: int, k: int, count: np.ndarray | None = None, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best but `own`, ties to smaller ids, of scores from `least` on. count[0] gets the number of distances computed."""
        q = np.append(query, 0.0)
        base = float(q @ q) + self.top
        slack = 1e-9 * (base + 1)
        worst, worst_id, scores, ids = least, LONG, np.empty(0), np.empty(0, np.int64)
        most = float(np.abs(query).max(initial=0)) * self.largest * max(1, len(query))
        exact, asked = most < EXACT, query.astype(self.kind) if most < 2**24 else query
        reach_of = lambda score: np.sqrt(max(0.0, base - 2 * score + 4 * slack)) + 1e-9
        limit = reach_of(least) if least > -np.inf else np.inf  # distance beyond which nothing can enter
        heap: list = [(0.0, 0, self.root, None)]
        order = 1
        while heap:
            low, _, node, to_node = heapq.heappop(heap)
            if low > limit:
                break
            if (base - low * low) / 2 + slack < worst + 1 and np.floor((base - low * low) / 2 + slack) == worst and node.smallest > worst_id:
                continue  # at best ties with larger ids
            may = np.ones(len(node.to_parent), bool)
            if to_node is not None and limit < np.inf:  # the stored distance to the parent spares computing this one
                reach = limit if node.children is None else limit + node.radius
                may = np.abs(to_node - node.to_parent) <= reach + 1e-9 * (1 + to_node)
            which = np.flatnonzero(may)
            if count is not None:
                count[0] += len(which)
            if node.children is None:
                vectors, at = (node.vectors, node.ids) if len(which) == len(may) else (node.vectors[which], node.ids[which])
                if exact:
                    got = (vectors @ asked).astype(np.float64)
                else:
                    got = np.array([max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(v, query, strict=True)))) for v in vectors], dtype=object)
                enters = np.flatnonzero(got >= worst)
                enters = enters[at[enters] != own]
                if not len(enters):
                    continue
                scores, ids = np.concatenate([scores, got[enters]]), np.concatenate([ids, at[enters]])
                best = np.lexsort((ids, -scores))[:k] if exact else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
                scores, ids = scores[best], ids[best]
                if len(ids) == k:
                    worst, worst_id = float(scores[-1]), int(ids[-1])
                    limit = reach_of(worst)
            else:
                gap = node.points[which] - q
                dist = np.sqrt(np.maximum((gap * gap).sum(1), 0))
                for i, d, lower in zip(which, dist, np.maximum(0, dist - node.radius[which] - 1e-9 * (1 + dist)), strict=True):
                    if lower <= limit:
                        heapq.heappush(heap, (lower, order, node.children[i], d))
                        order += 1
        return scores, ids


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scaled(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([vectors, np.sqrt(np.maximum(top - (vectors * vectors).sum(1), 0))])


def far_apart(points: np.ndarray, many: int) -> np.ndarray:
    """Up to `many` of the points, each the farthest from those before."""
    if not len(points):
        return points
    picked, far = [0], np.linalg.norm(points - points[0], axis=1)
    while len(picked) < many and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[picked[-1]], axis=1))
    return points[picked]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances within about 1e-6 of the points' norms."""
    squares = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def dealt(rows: DataFrame, asks: DataFrame, query_block: int, k: int, width: int, top: float, page: int, fanout: int) -> DataFrame:
    """key, query_id, vec_id, score of the best in each block that a query names. rows: vec_id, v, cell, sub; asks: key, vec_id, v, least, cell, sub.

    A block meets its queries by `query_block` at a time, so neither side of a task grows.
    """
    parts = asks.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("long").alias("parts")).select(F.col("cell").alias("c"), F.col("sub").alias("s"), "parts")
    here = (F.col("cell") == F.col("c")) & (F.col("sub") == F.col("s"))
    left = rows.join(parts, here).select("cell", "sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "vec_id", "v", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("least"))
    right = asks.join(parts, here).select("cell", "sub", F.pmod(F.xxhash64("key", F.lit("part")), F.col("parts")).alias("part"), "vec_id", "v", "key", "least")

    def run(table: pa.Table) -> pa.Table:
        asking = table["key"].is_valid().to_numpy()
        data, ids = _matrix(table["v"], width), table["vec_id"].to_numpy()
        keys, least = table["key"].fill_null(0).to_numpy(), table["least"].fill_null(-np.inf).to_numpy()
        order = np.argsort(ids[~asking], kind="stable")
        out: list[list] = [[], [], [], []]
        if len(order):
            tree = MTree(data[~asking][order], ids[~asking][order], page, fanout, top)
            for q, own, key, low in zip(data[asking], ids[asking].tolist(), keys[asking].tolist(), least[asking].tolist(), strict=True):
                scores, found = tree.search(q, own, k, least=low)
                out[0] += [key] * len(found)
                out[1] += [own] * len(found)
                out[2] += found.tolist()
                out[3] += [int(x) for x in scores]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["key", "query_id", "vec_id", "score"])

    return left.unionByName(right).groupBy("cell", "sub", "part").applyInArrow(run, "key long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, every: int = 20, k: int = 20, block: int = 8192, query_block: int = 2048, page: int = 1024, fanout: int = 32, most_cells: int = 1024, sample: int = 4096) -> DataFrame:
    """The k best of all other rows for each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Components are floor(scale * x); the score is their inner product, ties go to the smaller id. Vectors that are
    null or hold null or non-finite components take no part, nor do null ids; missing components of shorter vectors
    count as 0. Rows of the query's own id are no candidates; other rows count as often as they are there; queries alike
    in id and vector are asked once, of one id and several vectors each. Scores beyond 64 bits stop there. Fewer
    candidates than k give fewer rows, an empty table none; other columns are not read. Pivots (most_cells at most) come
    from the `sample` rows of the smallest hashes; every row is indexed. A task holds one block and query_block queries.
    """
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter("vec_id is not null and v is not null")
    sound = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = v.filter(sound).select("vec_id", scaled(F.col("v"), scale).alias("v")).withColumn("key", F.xxhash64("vec_id", "v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = v.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("width")).first()
    top, width = (sizes["top"] or 0.0) * (1 + 1e-9), sizes["width"] or 0
    picked = v.orderBy("key").limit(sample).select("v").toPandas()["v"].tolist()
    first = np.zeros((len(picked), width))
    for i, x in enumerate(picked):
        first[i, : len(x)] = x
    pivots = far_apart(lifted(first, top), min(most_cells, max(1, -(-sizes["n"] // block))))

    def place(batches):
        for batch in batches:
            points = lifted(_matrix(pa.chunked_array([batch.column(1)]), width), top)
            cell = distances(points, pivots).argmin(1) if len(points) else np.empty(0, int)
            far = np.linalg.norm(points - pivots[cell], axis=1) if len(points) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(far, pa.float64())], names=["vec_id", "v", "key", "salt", "cell", "far"])

    rows = v.select("vec_id", "v", "key", F.xxhash64("key", F.monotonically_increasing_id()).alias("salt"))
    table = cut(rows.mapInArrow(place, "vec_id long, v array<double>, key long, salt long, cell long, far double"), "vectors")
    cells = {r["cell"]: (r["far"], -(-r["n"] // block)) for r in table.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}  # most_cells at most
    subs = F.broadcast(v.sparkSession.createDataFrame([(c, many) for c, (_, many) in sorted(cells.items())], "of_cell long, many long"))
    rows = table.join(subs, F.col("cell") == F.col("of_cell")).withColumn("sub", F.pmod("salt", "many")).drop("of_cell", "many")
    asks = rows.filter(F.col("vec_id") % every == 0).select("key", "vec_id", "v", "cell").distinct()
    home = asks.withColumns({"least": F.lit(float("-inf")), "sub": F.lit(0).cast("long")})
    near = cut(dealt(rows, home, query_block, k, width, top, page, fanout), "topk-near")
    bound = near.groupBy(F.col("key").alias("of"), F.col("query_id").alias("of_id")).agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("low"))
    bound = asks.join(bound, (F.col("key") == F.col("of")) & (F.col("vec_id") == F.col("of_id")), "left")
    bound = bound.select("key", "vec_id", "v", F.col("cell").alias("home"), F.when((F.col("m") >= k) & (F.abs("low") < EXACT), F.col("low").cast("double")).otherwise(float("-inf")).alias("least"))
    radii = np.array([cells.get(c, (-np.inf, 0))[0] for c in range(len(pivots))])
    many = [cells.get(c, (0.0, 0))[1] for c in range(len(pivots))]

    def visits(batches):
        for batch in batches:
            data = _matrix(pa.chunked_array([batch.column(2)]), width)
            points = np.column_stack([data, np.zeros(len(data))])
            low = distances(points, pivots) - radii - 1e-5 * (1 + np.sqrt(top))
            base = (data * data).sum(1) + top
            least = batch.column(4).to_numpy()
            reach = np.where(np.isneginf(least), np.inf, np.sqrt(np.maximum(base - 2 * np.where(np.isneginf(least), 0, least) + 4e-9 * (base + 1), 0)) + 1e-9)
            at, cell, sub = [], [], []
            for i, home in enumerate(batch.column(3).to_pylist()):
                for c in np.flatnonzero(low[i] <= reach[i] + 1e-9 * (1 + reach[i])).tolist():
                    for s in range(many[c]):
                        if (c, s) != (home, 0):
                            at.append(i)
                            cell.append(c)
                            sub.append(s)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(take) for j in (0, 1, 2, 4)], pa.array(cell, pa.int64()), pa.array(sub, pa.int64())], names=["key", "vec_id", "v", "least", "cell", "sub"])

    far = cut(bound.mapInArrow(visits, "key long, vec_id long, v array<double>, least double, cell long, sub long"), "topk-visits")
    found = near.unionByName(dealt(rows, far, query_block, k, width, top, page, fanout))
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    best = cut(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk")
    forget(table, near, far)
    return best
