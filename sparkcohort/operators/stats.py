"""Tests and regressions: ranks and sums are DataFrame aggregates; tail probabilities come from a pandas UDF over the few result rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkcohort.operators.order import bucketed, running


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else _gamma_upper(k / 2, v / 2) for v, k in zip(x, dof, strict=True)])


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)) for v in z])


def _fisher(a: int, b: int, c: int, d: int) -> float:
    row, col, n = a + b, a + c, a + b + c + d
    choose = lambda p, q: math.lgamma(p + 1) - math.lgamma(q + 1) - math.lgamma(p - q + 1)
    low, high = max(0, row + col - n), min(row, col)
    logs = [choose(col, k) + choose(n - col, row - k) - choose(n, row) for k in range(low, high + 1)]
    seen = logs[a - low]
    return min(1.0, sum(math.exp(x) for x in logs if x <= seen + 1e-7))


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([_fisher(*map(int, x)) for x in zip(a, b, c, d, strict=True)])


def mid_ranks(df: DataFrame, value: str, partition: Sequence[str] = ()) -> DataFrame:
    """df with rank: the mean rank of equal values, and ties: how many are equal. Ranks come from counts of distinct values, so equal rows are aggregated first."""
    counts = df.groupBy(*partition, value).agg(F.count(F.lit(1)).alias("_m"))
    if partition:
        upto = counts.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*partition).orderBy(value)))
    else:
        upto = running(bucketed(counts, value), value, "_m", "_upto").drop("_bucket")
    ranked = upto.withColumn("rank", F.col("_upto") - (F.col("_m") - 1) / 2).drop("_upto").withColumnRenamed("_m", "ties")
    return df.join(ranked, [*partition, value])


def mann_whitney(df: DataFrame, group: str, one: object, two: object, value: str) -> DataFrame:
    """One row: n1, n2, medians, U of group one, rank-biserial r = 2U / (n1 n2) - 1, z with tie and continuity corrections. Below two values on a side all but n is null."""
    rows = df.filter(F.col(group).isin(one, two) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    r = mid_ranks(rows, "v")
    is1 = F.col("g") == one
    sums = r.agg(F.count_if(is1).alias("n1"), F.count_if(~is1).alias("n2"), F.sum(F.when(is1, F.col("rank"))).alias("r1"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("t"), F.median(F.when(is1, F.col("v"))).alias("median_1"), F.median(F.when(~is1, F.col("v"))).alias("median_2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    ok = (n1 >= 2) & (n2 >= 2)
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("t") / (n * (n - 1))))
    z = F.when(sd > 0, (F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0))) / sd * F.signum(u - n1 * n2 / 2))
    return sums.select("n1", "n2", "median_1", "median_2", F.when(ok, u).alias("u"), F.when(ok, 2 * u / (n1 * n2) - 1).alias("r"), F.when(ok, z).alias("z"))


def wilcoxon_signed(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n of the non-zero differences, W of the positive and negative ones, z without continuity correction."""
    d = df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).filter("d <> 0").withColumn("m", F.abs("d"))
    r = mid_ranks(d, "m")
    s = r.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("t"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    return s.select("n", "w_plus", "w_minus", ((F.least("w_plus", "w_minus") - n * (n + 1) / 4) / sd).alias("z"))


def category_tests(df: DataFrame, group: str, one: object, two: object, category: str) -> DataFrame:
    """category, a, b (in group one: with and without), c, d, odds_ratio, p: one 2x2 table for each category."""
    rows = df.filter(F.col(group).isin(one, two) & F.col(category).isNotNull())
    per = rows.groupBy(F.col(category).alias("category")).agg(F.count_if(F.col(group) == one).alias("a"), F.count_if(F.col(group) == two).alias("c"))
    total = rows.agg(F.count_if(F.col(group) == one).alias("n1"), F.count_if(F.col(group) == two).alias("n2"))
    t = per.crossJoin(total).select("category", "a", (F.col("n1") - F.col("a")).alias("b"), "c", (F.col("n2") - F.col("c")).alias("d"))
    odds = F.when(F.col("b") * F.col("c") > 0, F.col("a") * F.col("d") / (F.col("b") * F.col("c")))
    return t.withColumns({"odds_ratio": odds, "p": fisher_two_sided("a", "b", "c", "d")})


def benjamini_hochberg(df: DataFrame, key: str, p: str) -> DataFrame:
    """key, p, p_adjusted: p n / rank, made monotone from the largest p down, at most 1. A null p is no test: it stays null and does not count.

    Equal p take the last rank among them, so only counts of distinct p are ordered.
    """
    counts = bucketed(df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_m")), "_p")
    n = df.agg(F.count(p).alias("_n"))
    raw = running(counts, "_p", "_m", "_r").crossJoin(F.broadcast(n)).withColumn("_x", F.col("_p") * F.col("_n") / F.col("_r"))  # one row
    adjusted = running(raw, "_p", "_x", "_low", "min", descending=True).select("_p", F.least(F.lit(1.0), "_low").alias("p_adjusted"))
    return df.select(key, p).join(adjusted, F.col(p) == F.col("_p"), "left").select(key, p, "p_adjusted")


def squared_correlation(x: Column, y: Column) -> Column:
    return F.pow(F.corr(x, y), F.lit(2))


def logistic_vs_rest(df: DataFrame, outcome: str, numeric: Sequence[str], most_rounds: int = 30) -> DataFrame:
    """term, coefficient, odds_ratio, low, high (95 % Wald), p of a logistic regression on complete cases, numerics z-scored (n).

    Newton steps: each is one aggregate of k x k sums over the rows; only those sums come to the driver. Guards as
    notes: fewer than 10 events a term, a condition above 1e8, or a coefficient above 15 gives a null row with a note.
    """
    rows = df.select(F.col(outcome).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(numeric)]).na.drop()
    k = len(numeric) + 1
    m = rows.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(1, k) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.sum("y").alias("events"), F.count(F.lit(1)).alias("n")).first()
    terms = ["intercept", *numeric]
    schema = "term string, coefficient double, odds_ratio double, low double, high double, p double, note string"
    empty = lambda note: df.sparkSession.createDataFrame([(t, None, None, None, None, None, note) for t in terms], schema)
    if min(m["events"] or 0, m["n"] - (m["events"] or 0)) < 10 * (k - 1):
        return empty("fewer than 10 events a term")
    if any(not m[f"s{i}"] for i in range(1, k)):
        return empty("a constant term")
    z = rows.select("y", F.lit(1.0).alias("x0"), *[((F.col(f"x{i}") - m[f"m{i}"]) / m[f"s{i}"]).alias(f"x{i}") for i in range(1, k)])
    beta = np.zeros(k)
    for _ in range(most_rounds):
        eta = sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        w = mu * (1 - mu)
        sums = z.agg(*[F.sum(F.col(f"x{i}") * (F.col("y") - mu)).alias(f"g{i}") for i in range(k)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * w).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        g = np.array([sums[f"g{i}"] for i in range(k)])
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        if np.linalg.cond(h) > 1e8:
            return empty("ill conditioned")
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(beta).max() > 15:
            return empty("separated: a coefficient above 15")
        if np.abs(step).max() < 1e-9:
            break
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    out = [(t, float(b), math.exp(b), math.exp(b - 1.959963984540054 * s), math.exp(b + 1.959963984540054 * s), math.erfc(abs(b / s) / math.sqrt(2)), None) for t, b, s in zip(terms, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(out, schema)
