"""Agreement of two labelings: everything follows from the crosstab, one aggregate over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.functions.scalars import NOISE


def crosstab(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """a, b, n of the cells that occur."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def crosstab_percent(cells: DataFrame) -> DataFrame:
    """Cells with their share of the row and of the column in percent."""
    row, col = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    return cells.withColumns({"row_pct": 100.0 * F.col("n") / row, "col_pct": 100.0 * F.col("n") / col})


def noise_as_singletons(df: DataFrame, label: str, key: str) -> DataFrame:
    """Each noise row a cluster of its own: labels become text, noise rows take their key."""
    return df.withColumn(label, F.when(F.col(label) == NOISE, F.concat(F.lit("noise "), F.col(key).cast("string"))).otherwise(F.col(label).cast("string")))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def margins(cells: DataFrame) -> DataFrame:
    """One row: sums over cells, rows and columns of pairs and of n ln n, and the total."""
    x = lambda n: F.col(n).cast("double")
    entropy = lambda n: F.sum(x(n) * F.log(x(n)))
    cell = cells.agg(F.sum(_pairs(x("n"))).alias("ab"), entropy("n").alias("h_ab"), F.sum(x("n")).alias("total"))
    out = cell
    for side in ("a", "b"):
        sums = cells.groupBy(side).agg(F.sum("n").alias("m")).agg(F.sum(_pairs(x("m"))).alias(f"pairs_{side}"), entropy("m").alias(f"h_{side}"), F.count(F.lit(1)).alias(f"k_{side}"))
        out = out.crossJoin(sums)  # one row each
    return out


def agreement(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: ari, nmi, homogeneity and completeness (b as truth); noise is a group of its own."""
    m = margins(crosstab(df, a, b))
    total = F.col("total")
    every = _pairs(total)
    expected = F.col("pairs_a") * F.col("pairs_b") / every
    ceiling = (F.col("pairs_a") + F.col("pairs_b")) / 2
    ari = F.when(ceiling == expected, 1.0).otherwise((F.col("ab") - expected) / (ceiling - expected))
    entropy = lambda h: F.log(total) - F.col(h) / total
    h_a, h_b = entropy("h_a"), entropy("h_b")
    mutual = F.greatest(h_a + h_b - entropy("h_ab"), F.lit(0.0))
    share = lambda h: F.when(h <= 1e-15, 1.0).otherwise(mutual / h)
    nmi = F.when((F.col("k_a") == 1) & (F.col("k_b") == 1), 1.0).when((h_a + h_b) <= 1e-15, 1.0).otherwise(2 * mutual / (h_a + h_b))
    return m.select(total.cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"), share(h_b).alias("homogeneity"), share(h_a).alias("completeness"))


def pair_counts(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: unordered pairs together in both, in a only, in b only, and apart in both."""
    m = margins(crosstab(df, a, b))
    both = F.col("ab")
    only_a, only_b = F.col("pairs_a") - both, F.col("pairs_b") - both
    return m.select(*[c.cast("long").alias(n) for c, n in ((both, "both"), (only_a, "only_a"), (only_b, "only_b"), (_pairs(F.col("total")) - both - only_a - only_b, "neither"))])


def external_indices(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: jaccard, fowlkes_mallows, gamma; null with a note where a side has all rows together or all apart."""
    p = pair_counts(df, a, b).select(*[F.col(c).cast("double").alias(c) for c in ("both", "only_a", "only_b", "neither")])
    m1, m2 = F.col("both") + F.col("only_a"), F.col("both") + F.col("only_b")
    total = m1 + F.col("only_b") + F.col("neither")
    bad = (m1 == 0) | (m2 == 0) | (m1 == total) | (m2 == total)
    gamma = (total * F.col("both") - m1 * m2) / F.sqrt(m1 * m2 * (total - m1) * (total - m2))
    jaccard = F.col("both") / (F.col("both") + F.col("only_a") + F.col("only_b"))
    value = lambda c: F.when(~bad, c)
    return p.select(value(jaccard).alias("jaccard"), value(F.col("both") / F.sqrt(m1 * m2)).alias("fowlkes_mallows"), value(gamma).alias("gamma"), F.when(bad, "a side has one cluster, or only singletons").alias("note"))


def purity(cells: DataFrame) -> DataFrame:
    """Per a: n, the b with most rows (the smallest of equals) and its share in percent."""
    w = Window.partitionBy("a")
    best = F.row_number().over(w.orderBy(F.desc("n"), "b"))
    return cells.withColumns({"total": F.sum("n").over(w), "place": best}).filter("place = 1").select("a", F.col("total").alias("n"), F.col("b").alias("dominant"), (100.0 * F.col("n") / F.col("total")).alias("purity_pct"))


def chi_square(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row: chi2, dof; per cell of the full grid: a, b, n, expected, residual). A 2x2 table has the continuity correction in chi2, not in the residuals."""
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    size = cells.agg(F.sum("n").alias("t"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"))
    grid = rows.crossJoin(cols).crossJoin(size).join(cells, ["a", "b"], "left")  # the two label sets, not rows
    e = F.col("ra").cast("double") * F.col("cb") / F.col("t")
    n = F.coalesce(F.col("n"), F.lit(0))
    full = grid.select("a", "b", n.alias("n"), e.alias("expected"), ((n - e) / F.sqrt(e)).alias("residual"), "ka", "kb")
    gap = F.abs(F.col("n") - F.col("expected"))
    two = (F.col("ka") == 2) & (F.col("kb") == 2)
    gap = F.when(two, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    total = full.agg(F.sum(gap * gap / F.col("expected")).alias("chi2"), ((F.max("ka") - 1) * (F.max("kb") - 1)).cast("long").alias("dof"))
    return total, full.drop("ka", "kb")


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, dim, value: the mean of each coordinate."""
    return df.select(F.col(label).alias("label"), F.posexplode(vector).alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroid_vectors(df: DataFrame, label: str, vector: str) -> DataFrame:
    c = centroids(df, label, vector).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("x"))
    return c.select("label", F.transform("x", lambda v: v["value"]).alias("centroid"))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def nearest_members(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """label, key, distance: the member nearest to its cluster's centroid (the smallest key of equals)."""
    c = centroid_vectors(df, label, vector).withColumnRenamed("label", "_label")
    d = df.join(c, F.col(label) == F.col("_label")).select(F.col(label).alias("label"), F.col(key).alias(key), euclidean(vector, "centroid").alias("distance"))
    return d.groupBy("label").agg(F.min(F.struct("distance", key)).alias("m")).select("label", f"m.{key}", "m.distance")


def centroid_separation(df: DataFrame, label: str, vector: str, one: object, two: object) -> DataFrame:
    """One row: distance of two centroids and the mean distance of members to their own (the radii)."""
    c = centroid_vectors(df.filter(F.col(label).isin(one, two)), label, vector)
    a, b = (c.filter(F.col("label") == x).select(F.col("centroid").alias(n)) for x, n in ((one, "c1"), (two, "c2")))
    ends = a.crossJoin(b)  # one row each
    near = df.join(c.withColumnRenamed("label", "_l"), F.col(label) == F.col("_l")).agg(F.avg(F.when(F.col(label) == one, euclidean(vector, "centroid"))).alias("radius_1"), F.avg(F.when(F.col(label) == two, euclidean(vector, "centroid"))).alias("radius_2"))
    return ends.select(euclidean("c1", "c2").alias("distance")).crossJoin(near)


def linkage_agreement(runs: DataFrame, group: list[str], variant: str, key: str, label: str) -> DataFrame:
    """group, variant_a, variant_b, ari for each two variants of a group. One self-join on the key; the crosstabs are grouped."""
    a = runs.select(*group, F.col(key).alias("_k"), F.col(variant).alias("variant_a"), F.col(label).alias("a"))
    b = runs.select(*group, F.col(key).alias("_k"), F.col(variant).alias("variant_b"), F.col(label).alias("b"))
    keys = [*group, "variant_a", "variant_b"]
    cells = a.join(b, [*group, "_k"]).filter("variant_a < variant_b").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = cells.groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias("ab"), F.sum("n").alias("total"))
    for s in "ab":
        side = cells.groupBy(*keys, s).agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(_pairs(F.col("m"))).alias(f"p{s}"))
        both = both.join(side, keys)
    expected = F.col("pa") * F.col("pb") / _pairs(F.col("total"))
    ceiling = (F.col("pa") + F.col("pb")) / 2
    return both.select(*keys, F.when(ceiling == expected, 1.0).otherwise((F.col("ab") - expected) / (ceiling - expected)).alias("ari"))
