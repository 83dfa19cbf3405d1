"""Embeddings and how well they keep neighbourhoods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.operators.cluster import distance_matrix
from sparkcohort.operators.pairs import both_ways, dense_pairs
from sparkcohort.operators.reduce import Pca, varimax


def pca_embedding(df: DataFrame, key: str, vector: str, *, n_components: int | None = None, variance_share: float | None = None, standardize: bool = False, rotate: bool = False) -> DataFrame:
    """key, scores. Exactly one of n_components and variance_share says how many."""
    if (n_components is None) == (variance_share is None):
        raise ValueError("give n_components or variance_share")
    p = Pca(df, vector, standardize)
    k = n_components or p.components_for(variance_share)
    return p.scores(df, [key], vector, k, varimax(p.loadings(k)) if rotate else None)


def tsne(x: np.ndarray, dims: int = 2, perplexity: float = 30.0, rounds: int = 500, seed: int = 0, distances: np.ndarray | None = None) -> np.ndarray:
    """Exact t-SNE of one cohort from its principal components: early exaggeration, momentum, adaptive gains."""
    d = distance_matrix(x) if distances is None else distances
    n = len(d)
    perplexity = min(perplexity, (n - 1) / 3)
    p = np.zeros((n, n))
    for i in range(n):
        own = np.delete(d[i] ** 2, i)
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(60):
            w = np.exp(-(own - own.min()) * beta)
            q = w / w.sum()
            entropy = -(q[q > 0] * np.log(q[q > 0])).sum()
            if abs(entropy - np.log(perplexity)) < 1e-5:
                break
            if entropy > np.log(perplexity):
                low, beta = beta, beta * 2 if high == np.inf else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    if x is not None:
        u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
        y = u[:, :dims] * s[:dims]
        y = y / max(y[:, 0].std(), 1e-12) * 1e-4
        if y.shape[1] < dims:
            y = np.hstack([y, rng.normal(0, 1e-4, (n, dims - y.shape[1]))])
    else:
        y = rng.normal(0, 1e-4, (n, dims))
    step, gain = np.zeros_like(y), np.ones_like(y)
    for r in range(rounds):
        near = 1 / (1 + distance_matrix(y) ** 2)
        np.fill_diagonal(near, 0)
        q = np.maximum(near / near.sum(), 1e-12)
        pull = ((12.0 if r < rounds // 4 else 1.0) * p - q) * near
        grad = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
        step = (0.5 if r < rounds // 4 else 0.8) * step - max(n / 48, 50) * gain * grad
        y = y + step
    return y - y.mean(0)


def tsne_groups(df: DataFrame, group: str | None, key: str, vector: str, **params) -> DataFrame:
    """group, key, scores: one cohort or combination a task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        y = tsne(np.array(part["x"].tolist(), float), **params)
        return pd.DataFrame({"group": part["group"], "key": part["key"], "scores": y.tolist()})

    rows = df.select((F.col(group).cast("string") if group else F.lit("all")).alias("group"), F.col(key).alias("key"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    return rows.groupBy("group").applyInPandas(run, f"group string, key {dict(rows.dtypes)['key']}, scores array<double>")


def trustworthiness(df: DataFrame, key: str, vector: str, embedded: DataFrame, scores: str, k: int) -> DataFrame:
    """One row: 1 less the scaled sum of how far down in the original order the false neighbours are. Needs k below half the rows."""
    n = df.count()
    if not 0 < k < n / 2:
        raise ValueError(f"k must lie in 1 .. {(n - 1) // 2}")
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    original = both_ways(dense_pairs(df, key, vector)).withColumn("r", place).select("i", "j", "r")
    near = both_ways(dense_pairs(embedded, key, scores)).withColumn("e", place).filter(F.col("e") <= k).select("i", "j")
    late = F.coalesce(F.sum(F.when(F.col("r") > k, F.col("r") - k)), F.lit(0))
    return original.join(near, ["i", "j"]).agg((1 - late * (2.0 / (n * k * (2.0 * n - 3 * k - 1)))).alias("trustworthiness"))


#: Reduction methods by name: key and scores of all rows. UMAP and PaCMAP need libraries that are not there.
REDUCERS = {
    "pca": lambda df, key, vector, **p: pca_embedding(df, key, vector, **p),
    "tsne": lambda df, key, vector, **p: tsne_groups(df, None, key, vector, **p).select("key", "scores").withColumnRenamed("key", key),
}


def embed(df: DataFrame, key: str, vector: str, method: str, **params) -> DataFrame:
    if method not in REDUCERS:
        raise ValueError(f"unknown reduction {method!r}; there are {sorted(REDUCERS)}")
    return REDUCERS[method](df, key, vector, **params)


def leading(scores: str, k: int):
    """The first k coordinates: for methods whose coordinates are ordered by variance only."""
    return F.slice(scores, 1, k)
