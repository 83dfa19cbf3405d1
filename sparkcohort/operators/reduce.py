"""Linear reduction: covariance sums are partial aggregates of the partitions; only p x p (or n x n) matrices come to the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def covariance(df: DataFrame, vector: str, standardize: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(covariance, means, scales, n): each partition sends its own sums, a p x p matrix at most. A NaN, or a constant column when standardizing, raises."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, None, None
        for part in parts:
            x = np.array(part["x"].tolist(), float)
            if len(x):
                n, s, q = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if q is None else q + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    rows = df.select(F.transform(vector, lambda v: v.cast("double")).alias("x")).mapInPandas(sums, "n long, s array<double>, q array<double>").collect()  # one row a partition
    n = sum(r["n"] for r in rows)
    if n < 2:
        raise ValueError("covariance needs two rows")
    s, q = sum(np.array(r["s"]) for r in rows), sum(np.array(r["q"]) for r in rows)
    mean = s / n
    cov = (q.reshape(len(s), -1) - n * np.outer(mean, mean)) / (n - 1)
    if not np.isfinite(cov).all():
        raise ValueError("a value is not finite")
    scale = np.ones(len(s))
    if standardize:
        scale = np.sqrt(np.diag(cov))
        if (scale <= 1e-12).any():
            raise ValueError("a constant column cannot be standardized")
        cov = cov / np.outer(scale, scale)
    return cov, mean, scale, n


class Pca:
    """Eigenvalues, descending and at least 0, and eigenvectors as columns; the largest entry of each is positive."""

    def __init__(self, df: DataFrame, vector: str, standardize: bool = False) -> None:
        cov, self.mean, self.scale, self.n = covariance(df, vector, standardize)
        values, vectors = np.linalg.eigh(cov)
        self.values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        self.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)

    def shares(self) -> np.ndarray:
        return self.values / self.values.sum()

    def components_for(self, share: float) -> int:
        return int(np.searchsorted(np.cumsum(self.shares()), share - 1e-12) + 1)

    def scores(self, df: DataFrame, keys: Sequence[str], vector: str, k: int, rotation: np.ndarray | None = None) -> DataFrame:
        """keys and scores: array of k, in DataFrame operations (k dot products a row)."""
        w = self.vectors[:, :k] / self.scale[:, None]
        if rotation is not None:
            w = (w / np.sqrt(np.maximum(self.values[:k], 1e-300))) @ rotation
        shift = self.mean @ w
        dot = lambda i: F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in w[:, i]]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, b: a + b) - float(shift[i])
        return df.select(*keys, F.array(*[dot(i) for i in range(k)]).alias("scores"))

    def loadings(self, k: int) -> np.ndarray:
        return self.vectors[:, :k] * np.sqrt(self.values[:k])


def varimax(loadings: np.ndarray, rounds: int = 500, tolerance: float = 1e-8) -> np.ndarray:
    """Orthogonal rotation that maximises the variance of squared loadings."""
    p, k = loadings.shape
    r, last = np.eye(k), 0.0
    for _ in range(rounds):
        x = loadings @ r
        u, s, v = np.linalg.svd(loadings.T @ (x**3 - x * (x**2).sum(0) / p))
        r = u @ v
        if s.sum() < last * (1 + tolerance):
            break
        last = s.sum()
    return r


def component_t_maps(long: DataFrame, scores: DataFrame, key: str, feature: str, value: str, k: int) -> DataFrame:
    """feature, t: t statistics of a regression of each feature on all scores; 0 for a constant feature. scores: key, scores.

    The k x k design is one aggregate; each feature needs its sums with the scores only.
    """
    s = scores.select(F.col(key).alias("_k"), F.array(F.lit(1.0), *[F.get("scores", i) for i in range(k)]).alias("_s"))
    m = k + 1
    d = s.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("_s", i) * F.get("_s", j)).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)]).first()
    gram = np.array([[d[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
    inverse, dof = np.linalg.inv(gram), d["n"] - m
    per = long.join(s, F.col(key) == F.col("_k")).groupBy(feature).agg(F.sum(F.col(value) * F.col(value)).cast("double").alias("yy"), F.array(*[F.sum(F.get("_s", i) * F.col(value)) for i in range(m)]).alias("xy"))
    beta = [sum((F.get("xy", j) * float(inverse[i, j]) for j in range(m)), F.lit(0.0)) for i in range(m)]
    rss = F.col("yy") - sum((beta[i] * F.get("xy", i) for i in range(m)), F.lit(0.0))
    spread = F.col("yy") - F.get("xy", 0) * F.get("xy", 0) / float(d["n"])
    t = lambda i: F.when((spread > 1e-12 * F.col("yy")) & (rss > 0), beta[i] / F.sqrt(rss / float(dof) * float(inverse[i, i]))).otherwise(0.0)
    return per.select(feature, F.array(*[t(i) for i in range(1, m)]).alias("t"))


def classical_mds(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    """id and coordinates from pairs (i, j, d), all on the driver: for cohorts of a few thousand rows, as eigen-decomposition is."""
    ids = sorted(set(pairs["i"]) | set(pairs["j"]))
    at = {v: n for n, v in enumerate(ids)}
    d2 = np.zeros((len(ids), len(ids)))
    i, j = pairs["i"].map(at).to_numpy(), pairs["j"].map(at).to_numpy()
    d2[i, j] = d2[j, i] = pairs["d"].to_numpy() ** 2
    mean = d2.mean(0)
    values, vectors = np.linalg.eigh(-0.5 * (d2 - mean - mean[:, None] + d2.mean()))
    top = np.argsort(values)[::-1][:k]
    x = vectors[:, top] * np.sqrt(np.clip(values[top], 0, None))
    return pd.DataFrame(x, columns=[f"dim{n}" for n in range(k)]).assign(id=ids)


class PrimalAxes:
    """What DualPca has (n, kept, values), for more rows than features: only p x p matrices are on the driver, and scores stay a table."""

    def __init__(self, df: DataFrame, vector: str, most: int) -> None:
        self.pca = Pca(df, vector)
        values = self.pca.values[:most]
        self.n, self.kept = self.pca.n, int((values > values.max(initial=0) * 1e-10).sum())
        self.values = values[: self.kept]

    def scores(self, df: DataFrame, key: str, vector: str) -> DataFrame:
        """id, scores; an axis may point the other way than with DualPca."""
        return self.pca.scores(df, [key], vector, self.kept).withColumnRenamed(key, "id")


class DualPca:
    """PCA for more features than rows: the n x n products of centred rows come from their distances, nothing is p x p.

    `values` and `coordinates` (id, dim0, ...) are on the driver, for cohorts of a few thousand rows; axes without variance
    are left out, and the largest score of each is positive.
    """

    def __init__(self, pairs: pd.DataFrame, most: int) -> None:
        self.n = len(set(pairs["i"]) | set(pairs["j"]))
        if self.n < 2:
            raise ValueError("two rows are needed")
        all_axes = classical_mds(pairs, min(most, self.n - 1))
        dims = [c for c in all_axes.columns if c != "id"]
        x = all_axes[dims].to_numpy()
        values = (x**2).sum(0) / (self.n - 1)
        self.kept = int((values > values.max(initial=0) * 1e-10).sum())
        flip = np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1.0, 1.0)
        self.values = values[: self.kept]
        self.coordinates = all_axes.assign(**dict(zip(dims, (x * flip).T, strict=True)))[["id", *dims[: self.kept]]]

    @classmethod
    def of_rows(cls, df: DataFrame, key: str, vector: str, most: int) -> DualPca | PrimalAxes:
        """From the rows: products of rows where there are fewer of them than features; else products of features, whose axes and values are the same."""
        from sparkcohort.operators.pairs import dense_pairs

        n, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
        if n < 2:
            raise ValueError("two rows are needed")
        return cls(dense_pairs(df, key, vector).toPandas(), most) if n <= width else PrimalAxes(df, vector, most)

    def scores(self, spark: SparkSession) -> DataFrame:
        """id, scores."""
        rows = [(int(r[0]), [float(v) for v in r[1:]]) for r in self.coordinates.itertuples(index=False)]
        return spark.createDataFrame(rows, "id long, scores array<double>")

    def loadings(self, long: DataFrame, key: str) -> DataFrame:
        """component, feature, loading (unit length over the features) from the long form (key, feature, value; absent = 0): one shuffle by feature."""
        scores = self.scores(long.sparkSession)
        sums = [F.sum(F.col("value") * F.get("scores", F.lit(i))).alias(f"c{i}") for i in range(self.kept)]
        per = long.join(F.broadcast(scores) if self.n <= 20_000 else scores, F.col(key) == F.col("id")).groupBy("feature").agg(*sums)
        unit = [F.struct(F.lit(i).alias("component"), (F.col(f"c{i}") / float(v * (self.n - 1))).alias("loading")) for i, v in enumerate(self.values)]
        return per.select("feature", F.explode(F.array(*unit)).alias("u")).select("u.component", "feature", "u.loading")


def map_reproducibility(a: DataFrame, b: DataFrame, feature: str, maps: str = "t") -> DataFrame:
    """component, correlation over features of two tables of maps (feature, array)."""
    x = a.select(feature, F.posexplode(maps).alias("component", "x"))
    y = b.select(feature, F.posexplode(maps).alias("component", "y"))
    return x.join(y, [feature, "component"]).groupBy("component").agg(F.corr("x", "y").alias("correlation"))


def rotated_shares(pca: Pca, k: int, rotation: np.ndarray) -> np.ndarray:
    """Share of all variance on each rotated component: the column sums of squared rotated loadings."""
    return ((pca.loadings(k) @ rotation) ** 2).sum(0) / pca.values.sum()
