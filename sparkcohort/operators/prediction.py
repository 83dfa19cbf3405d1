"""Ridge prediction with leave-one-out folds and a permutation test; folds and permutations are rows, one task each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _loo_errors(x: np.ndarray, y: np.ndarray, lam: float) -> np.ndarray:
    """Leave-one-out residuals of ridge with an intercept, in closed form."""
    n = len(y)
    xc, yc = x - x.mean(0), y - y.mean()
    hat = xc @ np.linalg.solve(xc.T @ xc + lam * np.eye(x.shape[1]), xc.T) + 1 / n
    return (yc - (hat - 1 / n) @ yc) / (1 - np.diag(hat))


def nested_prediction(x: np.ndarray, y: np.ndarray, grid: Sequence[float], i: int) -> tuple[float, float]:
    """(prediction of row i, the penalty chosen): the penalty has the least leave-one-out error on the other rows."""
    keep = np.arange(len(y)) != i
    errors = [(_loo_errors(x[keep], y[keep], lam) ** 2).mean() for lam in grid]
    lam = grid[int(np.argmin(errors))]
    xm, ym = x[keep].mean(0), y[keep].mean()
    xc = x[keep] - xm
    beta = np.linalg.solve(xc.T @ xc + lam * np.eye(x.shape[1]), xc.T @ (y[keep] - ym))
    return float(ym + (x[i] - xm) @ beta), float(lam)


def ridge_leave_one_out(spark: SparkSession, x: np.ndarray, y: np.ndarray, grid: Sequence[float]) -> DataFrame:
    """row, truth, predicted, penalty. The design of one cohort goes to each task with the fold's number."""

    def run(parts):
        for part in parts:
            got = [nested_prediction(x, y, grid, i) for i in part["id"]]
            yield pd.DataFrame({"row": part["id"], "truth": y[part["id"]], "predicted": [g[0] for g in got], "penalty": [g[1] for g in got]})

    return spark.range(len(y)).mapInPandas(run, "row long, truth double, predicted double, penalty double")


def accuracy(predictions: DataFrame) -> DataFrame:
    """One row: squared correlation of truth and prediction; null where either is constant."""
    ok = (F.stddev_pop("truth") > 0) & (F.stddev_pop("predicted") > 0)
    return predictions.agg(F.when(ok, F.pow(F.corr("truth", "predicted"), F.lit(2))).alias("r2"))


def permutation_p(spark: SparkSession, x: np.ndarray, y: np.ndarray, grid: Sequence[float], n: int, seed: int = 0) -> DataFrame:
    """One row: observed and p = (1 + permutations at least as good) / (1 + n). Each permutation has a seed of its own, so reruns agree."""

    def score(target: np.ndarray) -> float:
        p = np.array([nested_prediction(x, target, grid, i)[0] for i in range(len(target))])
        return float(np.corrcoef(target, p)[0, 1] ** 2) if p.std() > 0 and target.std() > 0 else 0.0

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"score": [score(np.random.default_rng([seed, int(i)]).permutation(y)) for i in part["id"]]})

    seen = score(y)
    return spark.range(n).mapInPandas(run, "score double").agg(F.lit(seen).alias("observed"), ((1 + F.count_if(F.col("score") >= seen)) / F.lit(1.0 + n)).alias("p"))
