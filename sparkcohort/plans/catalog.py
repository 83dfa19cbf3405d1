"""Registered queries of the cohort operators on the test tables, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcohort.functions import scalars as S
from sparkcohort.operators import cluster, compare, describe, pairs, reduce, relational, reshape, stability, stats, stripes, sweep, tree, validity
from sparkcohort.plans import matrices, production, tuning

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the tables as a query, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of one folder, read when they are named."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def r(c, places: int = 6):
    """As the oracles' round: of c * 10^places in floating point, halves away from zero, -0.0 for what is just below zero."""
    scale = float(10**places)
    y = c.cast("double") * scale
    near = F.rint(F.abs(y))
    out = (near + F.when(F.abs(y) - near == 0.5, 1.0).otherwise(0.0)) * F.signum(y) / scale
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), c.cast("double")).otherwise(out)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[r(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def labelings(t: Tables) -> DataFrame:
    """Two labelings of the embeddings: the table's, and one by id."""
    a = t.embeddings.select("vec_id", "label")
    b = t.embeddings.select("vec_id", (F.col("vec_id") % 7).cast("int").alias("label"))
    return relational.align(a, b, "vec_id", "label")


AB = "SELECT vec_id, label AS a, CAST(vec_id % 7 AS INT) AS b FROM embeddings"
MARGINS = f"""
ab AS ({AB}), c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM ab GROUP BY a, b),
ra AS (SELECT a, sum(n) AS n FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY b),
m AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS sab, (SELECT sum(n * (n - 1) / 2) FROM ra) AS sa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS sb, (SELECT sum(n) FROM c) AS t,
  (SELECT -sum(n / t * ln(n / t)) FROM c, (SELECT sum(n) AS t FROM c)) AS hab, (SELECT -sum(n / t * ln(n / t)) FROM ra, (SELECT sum(n) AS t FROM c)) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM rb, (SELECT sum(n) AS t FROM c)) AS hb)
"""


@query(f"WITH {MARGINS} SELECT CAST(t AS BIGINT) AS n, round((sab - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(2 * (ha + hb - hab) / (ha + hb), 6) AS nmi, round((ha + hb - hab) / hb, 6) AS homogeneity, round((ha + hb - hab) / ha, 6) AS completeness FROM m")
def agreement_report(t: Tables) -> DataFrame:
    return rounded(compare.agreement(labelings(t)))


@query(f"WITH {MARGINS} SELECT round(sab / (sa + sb - sab), 6) AS jaccard, round(sab / sqrt(sa * sb), 6) AS fowlkes_mallows, round((t * (t - 1) / 2 * sab - sa * sb) / sqrt(sa * sb * (t * (t - 1) / 2 - sa) * (t * (t - 1) / 2 - sb)), 6) AS gamma FROM m")
def pair_counting_indices(t: Tables) -> DataFrame:
    return rounded(compare.external_indices(labelings(t)).drop("note"))


@query(f"WITH {MARGINS} SELECT CAST(sab AS BIGINT) AS both, CAST(sa - sab AS BIGINT) AS only_a, CAST(sb - sab AS BIGINT) AS only_b, CAST(t * (t - 1) / 2 - sa - sb + sab AS BIGINT) AS neither FROM m")
def pair_counts(t: Tables) -> DataFrame:
    return compare.pair_counts(labelings(t))


SEGMENT_REGION = "SELECT c_mktsegment AS a, r_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def segment_region(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("a"), F.col("r_name").alias("b"))


@query(f"WITH x AS ({SEGMENT_REGION}), c AS (SELECT a, b, count(*) AS n FROM x GROUP BY a, b) SELECT a, b, n, round(100.0 * n / sum(n) OVER (PARTITION BY a), 6) AS row_pct, round(100.0 * n / sum(n) OVER (PARTITION BY b), 6) AS col_pct FROM c")
def contingency_pct(t: Tables) -> DataFrame:
    return rounded(compare.crosstab_percent(compare.crosstab(segment_region(t))))


@query(f"WITH x AS ({SEGMENT_REGION}), c AS (SELECT a, b, count(*) AS n FROM x GROUP BY a, b), w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY a) AS BIGINT) AS total, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS p FROM c) SELECT a, total AS n, b AS dominant, round(100.0 * n / total, 6) AS purity_pct FROM w WHERE p = 1")
def purity(t: Tables) -> DataFrame:
    return rounded(compare.purity(compare.crosstab(segment_region(t))))


CHI = "x AS (SELECT o_orderpriority AS a, o_orderstatus AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS ra FROM x GROUP BY a), cb AS (SELECT b, sum(n) AS cb FROM x GROUP BY b), g AS (SELECT ra.a, cb.b, coalesce(n, 0) AS n, ra * cb / (SELECT sum(n) FROM x) AS e FROM ra CROSS JOIN cb LEFT JOIN x ON x.a = ra.a AND x.b = cb.b)"


def priority_status(t: Tables) -> DataFrame:
    return compare.crosstab(t.orders, "o_orderpriority", "o_orderstatus")


@query(f"WITH {CHI} SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof FROM g")
def chi_square_stat(t: Tables) -> DataFrame:
    return rounded(compare.chi_square(priority_status(t))[0])


@query(f"WITH {CHI} SELECT a, b, CAST(n AS BIGINT) AS n, round(e, 6) AS expected, round((n - e) / sqrt(e), 6) AS residual FROM g")
def chi_square_residuals(t: Tables) -> DataFrame:
    return rounded(compare.chi_square(priority_status(t))[1])


def upper_gamma(a: str, x: str) -> str:
    """SQL of the regularised upper incomplete gamma, by the series of the lower one."""
    return f"greatest(0.0, 1 - (SELECT sum(exp(({a} + n) * ln({x}) - {x} - lgamma({a} + n + 1))) FROM (SELECT unnest(range(2000)) AS n)))"


@query(f"WITH {CHI}, s AS (SELECT sum((n - e) * (n - e) / e) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM g) SELECT round(chi2, 6) AS chi2, CAST(dof AS BIGINT) AS dof, round({upper_gamma('dof / 2.0', 'chi2 / 2')}, 6) AS p FROM s")
def chi_square_p(t: Tables) -> DataFrame:
    return rounded(compare.chi_square(priority_status(t))[0].withColumn("p", stats.chi2_tail("chi2", "dof")))


@query("SELECT c_mktsegment AS \"group\", count(c_acctbal) AS n_available, count(*) AS n_total, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median, round(stddev_samp(c_acctbal), 6) AS sd, round(min(c_acctbal), 6) AS min, round(max(c_acctbal), 6) AS max FROM customer GROUP BY 1")
def cluster_summary(t: Tables) -> DataFrame:
    return rounded(describe.numeric_summary(t.customer, "c_mktsegment", "c_acctbal"))


@query("SELECT o_orderstatus AS \"group\", o_orderpriority AS category, count(*) AS n FROM orders WHERE o_orderpriority <> '' GROUP BY 1, 2")
def category_counts(t: Tables) -> DataFrame:
    return describe.category_summary(t.orders, "o_orderstatus", "o_orderpriority")


@query("WITH s AS (SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS l, count(*) AS m FROM embeddings GROUP BY 1) SELECT CAST(sum(m) AS BIGINT) AS n, count(*) FILTER (l <> -1) AS clusters, CAST(coalesce(sum(m) FILTER (l = -1), 0) AS BIGINT) AS noise, round(coalesce(sum(m) FILTER (l = -1), 0) / sum(m), 6) AS noise_fraction, round(max(m) FILTER (l <> -1) / sum(m), 6) AS largest_share FROM s")
def partition_shape(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("label"))
    return rounded(describe.partition_shape(e, "label"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_a, l.doc_id IS NOT NULL AS in_b FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def presence_flags(t: Tables) -> DataFrame:
    return relational.presence(t.documents, t.labels, "doc_id")


@query("SELECT c_custkey, CASE WHEN NOT c_acctbal >= 0 THEN 'negative balance' WHEN c_mktsegment = 'MACHINERY' THEN 'segment' ELSE 'excluded by list' END AS reason FROM customer WHERE NOT c_acctbal >= 0 OR c_mktsegment = 'MACHINERY' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def admission_audit(t: Tables) -> DataFrame:
    listed = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    rules = [("negative balance", F.col("c_acctbal") >= 0), ("segment", F.col("c_mktsegment") != "MACHINERY")]
    return relational.admit(t.customer, "c_custkey", rules, listed)[1]


@query("SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars < 500 THEN 0 END) AS quality, CASE WHEN l.quality IS NOT NULL THEN 'labels' WHEN d.n_chars < 500 THEN 'length' END AS quality_source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def enrich_fill_gaps(t: Tables) -> DataFrame:
    base = t.documents.select("doc_id", F.lit(None).cast("int").alias("quality"))
    short = t.documents.filter("n_chars < 500").select("doc_id", F.lit(0).alias("quality"))
    return relational.fill_gaps(base, [("labels", t.labels.select("doc_id", "quality")), ("length", short)], "doc_id", "quality")


def supplier_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Registered: those in credit; fresh: those of the first nations, their names in capitals."""
    old = t.supplier.filter("s_acctbal >= 0").select("s_suppkey", "s_name", "s_acctbal")
    return old, t.supplier.filter("s_nationkey < 13").select("s_suppkey", F.upper("s_name").alias("s_name"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT s_suppkey, upper(s_name), NULL FROM supplier WHERE s_nationkey < 13 AND s_acctbal < 0")
def upsert_append(t: Tables) -> DataFrame:
    return relational.upsert(*supplier_parts(t), "s_suppkey", overwrite=False)


@query("SELECT s_suppkey, upper(s_name) AS s_name, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey < 13 UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal >= 0 AND s_nationkey >= 13")
def upsert_overwrite(t: Tables) -> DataFrame:
    return relational.upsert(*supplier_parts(t), "s_suppkey", overwrite=True)


@query("SELECT p_partkey, p_size AS old, p_size + 1 AS new FROM part WHERE p_retailprice >= 950")
def conflict_check(t: Tables) -> DataFrame:
    new = t.part.select("p_partkey", (F.col("p_size") + F.when(F.col("p_retailprice") >= 950, 1).otherwise(0)).alias("p_size"))
    return relational.conflicts(t.part, new, ["p_partkey"], "p_size")


@query("WITH o AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_acctbal >= 0), n AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 5000 THEN 0.0 ELSE s_acctbal END AS v FROM supplier WHERE s_nationkey < 13) SELECT coalesce(o.k, n.k) AS s_suppkey, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v <> n.v")
def table_changes(t: Tables) -> DataFrame:
    new = t.supplier.filter("s_nationkey < 13").select("s_suppkey", F.when(F.col("s_acctbal") > 5000, 0.0).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    return relational.changes(t.supplier.filter("s_acctbal >= 0").select("s_suppkey", "s_acctbal"), new, ["s_suppkey"])


@query("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS n_returned, count(*) FILTER (l_discount > 0.05) AS n_discounted, count(*) AS n FROM lineitem GROUP BY 1")
def group_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def exclusion_report(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


EVENT_TYPES = ("click", "view", "purchase")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in EVENT_TYPES) + " FROM events GROUP BY user_id")
def pivot_fill_zero(t: Tables) -> DataFrame:
    return reshape.pivot_fixed(t.events, "user_id", "event_type", F.lit(1).cast("long"), EVENT_TYPES)


NATION_PAIRS = "WITH n AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS m FROM customer GROUP BY 1, 2)"


@query(f"{NATION_PAIRS} SELECT CASE WHEN x.n_name < y.n_name THEN x.n_name || '__' || y.n_name ELSE y.n_name || '__' || x.n_name END AS edge, CAST(sum(a.m * b.m) AS BIGINT) AS weight FROM n a JOIN n b ON a.s = b.s AND a.k < b.k JOIN nation x ON x.n_nationkey = a.k JOIN nation y ON y.n_nationkey = b.k GROUP BY 1")
def upper_triangle(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("m")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    a, b = n.select("c_mktsegment", F.col("n_name").alias("i"), F.col("m").alias("mi")), n.select("c_mktsegment", F.col("n_name").alias("j"), F.col("m").alias("mj"))
    return reshape.upper_triangle(a.join(b, "c_mktsegment").groupBy("i", "j").agg(F.sum(F.col("mi") * F.col("mj")).alias("weight")), "i", "j", "weight")


@query("WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS feature, unnest(embedding) AS v FROM embeddings), y AS (SELECT feature, CASE WHEN feature % 8 = 0 THEN 1.0 ELSE round(CAST(v AS DOUBLE), 6) END AS v FROM x) SELECT CAST(feature AS INT) AS feature, count(*) AS n FROM y GROUP BY feature HAVING min(v) <> max(v)")
def drop_constant_features(t: Tables) -> DataFrame:
    long = reshape.explode_features(t.embeddings, "vec_id", "embedding").withColumn("value", F.when(F.col("feature") % 8 == 0, 1.0).otherwise(r(F.col("value").cast("double"))))
    return reshape.drop_constant_features(long, "vec_id").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


D = "d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
BOTH = "w AS (SELECT i, j, li, lj, d FROM d UNION ALL SELECT j, i, lj, li, d FROM d)"


def embedding_pairs(t: Tables) -> DataFrame:
    return pairs.dense_pairs(t.embeddings, "vec_id", "embedding")


def embedding_labels(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("key"), "label")


def embedding_sums(t: Tables) -> DataFrame:
    return stripes.label_sums(t.embeddings, "vec_id", "embedding", embedding_labels(t))


@query(f"WITH {D} SELECT i, j, round(d, 6) AS d FROM d")
def pairwise_euclidean(t: Tables) -> DataFrame:
    return rounded(embedding_pairs(t))


SETS = "s AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS f FROM lineitem), z AS (SELECT k, count(*) AS n FROM s GROUP BY k), p AS (SELECT a.k AS i, b.k AS j, count(*) AS shared FROM s a JOIN s b ON a.f = b.f AND a.k < b.k GROUP BY 1, 2)"


@query(f"WITH {SETS} SELECT i, j, shared, round(1 - shared / CAST(x.n + y.n - shared AS DOUBLE), 6) AS d FROM p JOIN z x ON x.k = i JOIN z y ON y.k = j")
def pairwise_jaccard(t: Tables) -> DataFrame:
    return rounded(pairs.set_pairs(t.lineitem, "l_suppkey", "l_partkey", "jaccard"))


@query(f"WITH {SETS} SELECT i, j, shared, round(1 - 2 * shared / CAST(x.n + y.n AS DOUBLE), 6) AS d FROM p JOIN z x ON x.k = i JOIN z y ON y.k = j")
def pairwise_dice(t: Tables) -> DataFrame:
    return rounded(pairs.set_pairs(t.lineitem, "l_suppkey", "l_partkey", "dice"))


@query("WITH s AS (SELECT l_suppkey AS k, l_partkey AS f, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), z AS (SELECT k, sum(w) AS s FROM s GROUP BY k), p AS (SELECT a.k AS i, b.k AS j, sum(least(a.w, b.w)) AS m FROM s a JOIN s b ON a.f = b.f AND a.k < b.k GROUP BY 1, 2) SELECT i, j, round(1 - 2 * m / (x.s + y.s), 6) AS d FROM p JOIN z x ON x.k = i JOIN z y ON y.k = j")
def weighted_dice(t: Tables) -> DataFrame:
    return rounded(pairs.weighted_pairs(t.lineitem, "l_suppkey", "l_partkey", "l_quantity"))


@query(f"WITH {SETS}, n AS (SELECT count(*) AS n FROM z), q AS (SELECT count(*) AS m FROM p) SELECT round(1 - m / (CAST(n AS DOUBLE) * (n - 1) / 2), 6) AS saturated_share FROM n, q")
def saturated_pairs(t: Tables) -> DataFrame:
    return rounded(pairs.disjoint_share(t.lineitem, "l_suppkey", "l_partkey"))


@query(f"WITH {D}, {BOTH}, k AS (SELECT i, j, round(d, 6) AS d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS place FROM w) SELECT i, j, d, CAST(place AS INT) AS place FROM k WHERE place <= 5")
def knn_topk(t: Tables) -> DataFrame:
    return rounded(stripes.nearest_rows(t.embeddings, "vec_id", "embedding", 5))


@query(f"WITH {D}, {BOTH}, k AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY d) AS r FROM w), q AS (SELECT * FROM k WHERE r <= 10), e AS (SELECT *, r = max(r) OVER (PARTITION BY i) AS tie FROM q), p AS (SELECT i, li, count(*) FILTER (NOT tie) AS sure, count(*) FILTER (NOT tie AND li = lj) AS ss, count(*) FILTER (tie) AS ties, count(*) FILTER (tie AND li = lj) AS ts FROM e GROUP BY i, li), u AS (SELECT li AS label, count(*) AS n, avg((ss + (10 - sure) * ts / CAST(ties AS DOUBLE)) / 10) AS purity, avg(CASE WHEN ties > 10 - sure THEN 1.0 ELSE 0.0 END) AS tied_share FROM p GROUP BY li) SELECT label, n, round(purity, 6) AS purity, round((n - 1) / CAST((SELECT count(*) FROM embeddings) - 1 AS DOUBLE), 6) AS chance, round(least(1.0, (n - 1) / 10.0), 6) AS max_possible, n > 10 AS evaluable, round(tied_share, 6) AS tied_share FROM u")
def knn_purity(t: Tables) -> DataFrame:
    labels = embedding_labels(t)
    return rounded(pairs.purity_of_shares(stripes.nearest_shares(t.embeddings, "vec_id", "embedding", labels, 10), labels, 10))


SIL = f"{D}, {BOTH}, m AS (SELECT i, li, lj, avg(d) AS m FROM w GROUP BY i, li, lj), s AS (SELECT i, li, max(m) FILTER (li = lj) AS a, min(m) FILTER (li <> lj) AS b FROM m GROUP BY i, li), x AS (SELECT i, li AS label, CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM s)"


@query(f"WITH {SIL} SELECT label, count(*) AS n, round(avg(s), 6) AS mean, round(avg(CASE WHEN s < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_share FROM x GROUP BY label")
def silhouette_by_cluster(t: Tables) -> DataFrame:
    return rounded(describe.silhouette_breakdown(validity.silhouette_of_sums(embedding_sums(t))))


CENT = "x AS (SELECT vec_id, label, unnest(range(0, 64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT label, dim, avg(v) AS c FROM x GROUP BY label, dim)"


@query(f"WITH {CENT}, g AS (SELECT dim, avg(v) AS g FROM x GROUP BY dim), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), r AS (SELECT x.vec_id, x.label, sqrt(sum((v - c) * (v - c))) AS d, sum((v - c) * (v - c)) AS q FROM x JOIN c USING (label, dim) GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM r GROUP BY label), bw AS (SELECT sum(n.n * (c - g) * (c - g)) AS b FROM c JOIN g USING (dim) JOIN n USING (label)), k AS (SELECT count(*) AS k, sum(n) AS t FROM n), ch AS (SELECT (b / (k - 1)) / ((SELECT sum(q) FROM r) / (t - k)) AS ch FROM bw, k), m AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY 1, 2), db AS (SELECT m.a, max((x.s + y.s) / m) AS w FROM m JOIN s x ON x.label = m.a JOIN s y ON y.label = m.b GROUP BY m.a) SELECT round((SELECT ch FROM ch), 6) AS calinski_harabasz, round(avg(w), 6) AS davies_bouldin FROM db")
def ch_db_from_pairs(t: Tables) -> DataFrame:
    return rounded(validity.dispersion_of_sums(embedding_sums(t), embedding_labels(t)))


@query(f"WITH {D} SELECT round(min(d) FILTER (li <> lj) / max(d) FILTER (li = lj), 6) AS dunn FROM d")
def dunn(t: Tables) -> DataFrame:
    return rounded(validity.dunn(embedding_pairs(t), embedding_labels(t)))


@query(f"WITH {CENT} SELECT label, CAST(dim AS INT) AS dim, round(c, 6) AS value FROM c")
def cluster_centroids(t: Tables) -> DataFrame:
    return rounded(compare.centroids(t.embeddings, "label", "embedding"))


@query(f"WITH {CENT}, r AS (SELECT x.vec_id, x.label, sqrt(sum((v - c) * (v - c))) AS d FROM x JOIN c USING (label, dim) GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS p FROM r) SELECT label, vec_id, round(d, 6) AS distance FROM p WHERE p = 1")
def nearest_member(t: Tables) -> DataFrame:
    return rounded(compare.nearest_members(t.embeddings, "vec_id", "label", "embedding"))


@query(f"WITH {CENT}, r AS (SELECT x.vec_id, x.label, sqrt(sum((v - c) * (v - c))) AS d FROM x JOIN c USING (label, dim) GROUP BY 1, 2) SELECT round(sqrt(sum((a.c - b.c) * (a.c - b.c))), 6) AS distance, round((SELECT avg(d) FROM r WHERE label = 1), 6) AS radius_1, round((SELECT avg(d) FROM r WHERE label = 2), 6) AS radius_2 FROM c a JOIN c b ON a.dim = b.dim AND a.label = 1 AND b.label = 2")
def centroid_separation(t: Tables) -> DataFrame:
    return rounded(compare.centroid_separation(t.embeddings, "label", "embedding", 1, 2))


P = "p AS (SELECT p_partkey, p_retailprice / (SELECT max(p_retailprice) FROM part) AS p FROM part)"


@query(f"WITH {P}, o AS (SELECT p_partkey, p, row_number() OVER (ORDER BY p, p_partkey) AS r, count(*) OVER () AS n FROM p) SELECT p_partkey, round(p, 6) AS p, round(least(1.0, min(p * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adjusted FROM o")
def bh_correction(t: Tables) -> DataFrame:
    top = t.part.agg(F.max("p_retailprice")).first()[0]
    return rounded(stats.benjamini_hochberg(t.part.select("p_partkey", (F.col("p_retailprice") / top).alias("p")), "p_partkey", "p"))


@query("WITH m AS (SELECT o_orderpriority, CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS month, count(*) AS n FROM orders GROUP BY 1, 2) SELECT *, lag(n) OVER w AS previous, n - lag(n) OVER w AS change FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)")
def lag_sweep(t: Tables) -> DataFrame:
    m = t.orders.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyyMM").cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return describe.previous_value(m, ["o_orderpriority"], "month", "n")


@query("WITH v AS (SELECT n_name, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_name, CAST(row_number() OVER w AS INT) AS rank, round(v / sum(v) OVER (), 6) AS share, round(sum(v) OVER (ORDER BY v DESC, n_name ROWS UNBOUNDED PRECEDING) / sum(v) OVER (), 6) AS cumulative FROM v WINDOW w AS (ORDER BY v DESC, n_name)")
def cumulative_share(t: Tables) -> DataFrame:
    v = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(r(F.sum("o_totalprice"), 2).alias("v"))
    return rounded(describe.cumulative_share(v, "n_name", "v"))


@query("WITH v AS (SELECT DISTINCT CAST(floor(o_totalprice / 100) AS BIGINT) AS v FROM orders), g AS (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM v) SELECT min(v) AS first, max(v) AS last FROM g GROUP BY g")
def k_ranges(t: Tables) -> DataFrame:
    return describe.ranges(t.orders.select(F.floor(F.col("o_totalprice") / 100).cast("long").alias("v")), "v")


@query("WITH b AS (SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) AS l, count(*) FILTER (c_acctbal < 0) AS r FROM customer GROUP BY 1), i AS (SELECT c_nationkey, (l - r) / CAST(nullif(l + r, 0) AS DOUBLE) AS x FROM b) SELECT c_nationkey, round(x, 6) AS laterality_index, CASE WHEN x IS NULL THEN NULL WHEN abs(x) < 0.8 THEN 'both' WHEN x > 0 THEN 'left' ELSE 'right' END AS side FROM i")
def laterality_side(t: Tables) -> DataFrame:
    b = t.customer.groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("l"), F.count_if(F.col("c_acctbal") < 0).alias("r"))
    x = S.laterality_index(F.col("l"), F.col("r"))
    return b.select("c_nationkey", r(x).alias("laterality_index"), S.side_of(x, 0.8).alias("side"))


@query("WITH c AS (SELECT l_suppkey, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT l_suppkey, total, round(a / CAST(total AS DOUBLE), 6) AS fraction_A, round(n / CAST(total AS DOUBLE), 6) AS fraction_N, round(r / CAST(total AS DOUBLE), 6) AS fraction_R, CASE WHEN a = greatest(a, n, r) THEN 'A' WHEN n = greatest(a, n, r) THEN 'N' ELSE 'R' END AS dominant FROM c")
def location_fractions(t: Tables) -> DataFrame:
    return rounded(describe.fractions(t.lineitem, "l_suppkey", "l_returnflag", ["A", "N", "R"]))


@query("WITH n AS (SELECT count(DISTINCT o_custkey) AS n FROM orders) SELECT l_partkey, count(DISTINCT o_custkey) AS n, round(100.0 * count(DISTINCT o_custkey) / (SELECT n FROM n), 6) AS percent FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def overlap_map(t: Tables) -> DataFrame:
    n = t.orders.agg(F.countDistinct("o_custkey")).first()[0]
    return rounded(reshape.overlap_map(t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "l_partkey", n))


@query("WITH a AS (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, round(coalesce(a.v, 0) - coalesce(b.v, 0), 6) AS difference FROM a FULL JOIN b ON a.l_partkey = b.l_partkey")
def difference_map(t: Tables) -> DataFrame:
    one = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.sum("l_quantity").alias("v"))
    return rounded(reshape.difference_map(one("A"), one("R"), "l_partkey", "v"))


THRESHOLDS = (100.0, 300.0, 1000.0, 3000.0)


@query("SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CASE WHEN CAST(n_chars >= threshold AS INT) = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id), (SELECT unnest([100.0, 300.0, 1000.0, 3000.0]) AS threshold) GROUP BY 1")
def threshold_calibration(t: Tables) -> DataFrame:
    return rounded(describe.threshold_sweep(t.labels.join(t.documents, "doc_id"), "n_chars", "quality", THRESHOLDS))


MW = "v AS (SELECT quality AS g, CAST(n_chars AS DOUBLE) AS v FROM labels JOIN documents USING (doc_id)), k AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM v), s AS (SELECT count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n2, sum(r) FILTER (g = 1) AS r1 FROM k)"


@query(f"WITH {MW} SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2.0, 6) AS u, round(2 * (r1 - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * n2) - 1, 6) AS r FROM s")
def mann_whitney_u(t: Tables) -> DataFrame:
    return rounded(stats.mann_whitney(t.labels.join(t.documents, "doc_id"), "quality", 1, 0, "n_chars").select("n1", "n2", "u", "r"))


@query(f"""WITH {MW}, m AS (SELECT CAST(n1 AS DOUBLE) AS n1, CAST(n2 AS DOUBLE) AS n2, CAST(n1 + n2 AS DOUBLE) AS n, r1 - n1 * (n1 + 1) / 2.0 AS u, (SELECT CAST(sum(c * (c * c - 1)) AS DOUBLE) FROM (SELECT count(*) AS c FROM v GROUP BY v)) AS t FROM s),
z AS (SELECT u, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))) * sign(u - n1 * n2 / 2) AS z FROM m) SELECT round(u, 6) AS u, round(z, 6) AS z, round({upper_gamma('0.5', 'z * z / 2')}, 6) AS p FROM z""")
def mann_whitney_p(t: Tables) -> DataFrame:
    return rounded(stats.mann_whitney(t.labels.join(t.documents, "doc_id"), "quality", 1, 0, "n_chars").select("u", "z", stats.normal_two_sided("z").alias("p")))


@query("WITH d AS (SELECT l_extendedprice - 1000 * l_quantity AS d FROM lineitem), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0) SELECT count(*) AS n, round(sum(r) FILTER (d > 0), 1) AS w_plus, round(sum(r) FILTER (d < 0), 1) AS w_minus FROM k")
def wilcoxon(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_extendedprice", (1000 * F.col("l_quantity")).alias("q"))
    return rounded(stats.wilcoxon_signed(d, "l_extendedprice", "q").select("n", "w_plus", "w_minus"), 1)


@query("""WITH x AS (SELECT quality AS g, lang FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL AND quality IN (0, 1)), n AS (SELECT count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0 FROM x),
c AS (SELECT lang AS category, count(*) FILTER (g = 1) AS a, count(*) FILTER (g = 0) AS c FROM x GROUP BY 1), t AS (SELECT category, a, n1 - a AS b, c, n0 - c AS d, n1, n1 + n0 AS n FROM c, n),
k AS (SELECT *, a + c AS col, unnest(range(greatest(0, n1 + a + c - n), least(n1, a + c) + 1)) AS k FROM t),
l AS (SELECT *, lgamma(col + 1) - lgamma(k + 1) - lgamma(col - k + 1) + lgamma(n - col + 1) - lgamma(n1 - k + 1) - lgamma(n - col - n1 + k + 1) - lgamma(n + 1) + lgamma(n1 + 1) + lgamma(n - n1 + 1) AS l FROM k)
SELECT category, a, b, c, d, CASE WHEN b * c > 0 THEN round(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c), 6) END AS odds_ratio, round(least(1.0, sum(exp(l)) FILTER (l <= seen + 1e-7)), 6) AS p FROM (SELECT *, max(CASE WHEN k = a THEN l END) OVER (PARTITION BY category) AS seen FROM l) GROUP BY category, a, b, c, d""")
def fisher_by_category(t: Tables) -> DataFrame:
    return rounded(stats.category_tests(t.labels.join(t.documents, "doc_id"), "quality", 1, 0, "lang"))


@query("SELECT l_returnflag, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def squared_correlation(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(r(stats.squared_correlation(F.col("l_extendedprice"), F.col("l_quantity"))).alias("r2"))


RUNS = "u AS (SELECT r, vec_id, CAST((vec_id * (r + 3) + label) % 4 AS INT) AS l FROM embeddings, (SELECT unnest(range(0, 6)) AS r) WHERE (vec_id + r) % 5 <> 0), q AS (SELECT a.vec_id AS i, b.vec_id AS j, count(*) FILTER (a.l = b.l) AS together, count(*) AS sampled FROM u a JOIN u b ON a.r = b.r AND a.vec_id < b.vec_id GROUP BY 1, 2)"


def repeated_runs(t: Tables) -> DataFrame:
    each = t.embeddings.select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("r"))
    return each.filter("(vec_id + r) % 5 <> 0").select("r", "vec_id", ((F.col("vec_id") * (F.col("r") + 3) + F.col("label")) % 4).alias("l"))


@query(f"WITH {RUNS} SELECT i, j, together, sampled, round(together / CAST(sampled AS DOUBLE), 6) AS share FROM q")
def cooccurrence(t: Tables) -> DataFrame:
    return stability.cooccurrence(repeated_runs(t), "r", "vec_id", "l", r)  # rounded before the pairs are written out


@query(f"WITH {RUNS} SELECT round(1 - avg(CASE WHEN together / CAST(sampled AS DOUBLE) > 0.1 AND together / CAST(sampled AS DOUBLE) < 0.9 THEN 1.0 ELSE 0.0 END), 6) AS stability FROM q")
def monti_pac(t: Tables) -> DataFrame:
    return rounded(stability.consensus_ambiguity(repeated_runs(t), "r", "vec_id", "l"))


@query("SELECT k, linkage, metric, 'k=' || k || ',linkage=' || linkage || ',metric=' || metric AS combo_key FROM (SELECT CAST(unnest([2, 3, 4]) AS INT) AS k), (SELECT unnest(['ward', 'average']) AS linkage), (SELECT unnest(['euclidean', 'dice']) AS metric) WHERE linkage <> 'ward' OR metric = 'euclidean'")
def combo_grid(t: Tables) -> DataFrame:
    return sweep.valid_linkages(sweep.combo_grid(t.spark, {"k": [2, 3, 4], "linkage": ["ward", "average"], "metric": ["euclidean", "dice"]}), "linkage", "metric")


@query("SELECT 'p_brand' AS facet, p_brand AS value FROM part UNION SELECT 'p_type', p_type FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) UNION SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def facet_cascade(t: Tables) -> DataFrame:
    return sweep.facet_options(t.part, ["p_brand", "p_type", "p_size"], {"p_brand": t.part.agg(F.min("p_brand")).first()[0]})


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN url ELSE 'https://' || regexp_replace(regexp_replace(url, '^http://', ''), '[_-]', '', 'g') END AS canonical FROM pages")
def text_canonicalise(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.when(F.col("url").startswith("https://"), F.col("url")).otherwise(S.canonical_id(F.regexp_replace("url", "^http://", ""), "https://")).alias("canonical"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_keys(props) AS keys FROM events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.json_object_keys("props").alias("keys"))


@query(f"WITH ab AS ({AB}), u AS (SELECT 1 AS g, 'x' AS v, vec_id, a AS l FROM ab UNION ALL SELECT 1, 'y', vec_id, b FROM ab UNION ALL SELECT 1, 'z', vec_id, CAST(vec_id % 3 AS INT) FROM ab), c AS (SELECT p.g, p.v AS va, q.v AS vb, p.l AS a, q.l AS b, CAST(count(*) AS DOUBLE) AS n FROM u p JOIN u q ON p.g = q.g AND p.vec_id = q.vec_id AND p.v < q.v GROUP BY ALL), s AS (SELECT g, va, vb, sum(n * (n - 1) / 2) AS ab, sum(n) AS t FROM c GROUP BY ALL), x AS (SELECT g, va, vb, sum(m * (m - 1) / 2) AS pa FROM (SELECT g, va, vb, a, sum(n) AS m FROM c GROUP BY ALL) GROUP BY ALL), y AS (SELECT g, va, vb, sum(m * (m - 1) / 2) AS pb FROM (SELECT g, va, vb, b, sum(n) AS m FROM c GROUP BY ALL) GROUP BY ALL) SELECT g, va AS variant_a, vb AS variant_b, round((ab - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari FROM s JOIN x USING (g, va, vb) JOIN y USING (g, va, vb)")
def linkage_agreement(t: Tables) -> DataFrame:
    e = t.embeddings
    one = lambda v, l: e.select(F.lit(1).alias("g"), F.lit(v).alias("v"), "vec_id", l.cast("int").alias("l"))
    return rounded(compare.linkage_agreement(one("x", F.col("label")).unionByName(one("y", F.col("vec_id") % 7)).unionByName(one("z", F.col("vec_id") % 3)), ["g"], "v", "vec_id", "l"))


def _agrees(t: Tables, labels: DataFrame, key: str) -> DataFrame:
    return rounded(compare.agreement(labels.join(embedding_labels(t), F.col(key) == F.col("key")).select(F.col("label2").alias("a"), F.col("label").alias("b"))))


@query()
def kmeans(t: Tables) -> DataFrame:
    return _agrees(t, cluster.kmeans(t.embeddings.drop("label"), "vec_id", "embedding", 10)[0].withColumnRenamed("label", "label2"), "vec_id")


@query()
def gmm(t: Tables) -> DataFrame:
    return cluster.gaussian_mixture(t.embeddings.drop("label"), "vec_id", "embedding", 3)[0].select("vec_id", "label")


@query()
def pca(t: Tables) -> DataFrame:
    return reduce.Pca(t.embeddings, "embedding").scores(t.embeddings, ["vec_id"], "embedding", 5)


def _matrix(t: Tables, method: str, **params) -> DataFrame:
    return cluster.cluster_groups(t.embeddings.drop("label"), None, "vec_id", "embedding", method, **params).select(F.col("key").alias("vec_id"), "label")


@query()
def hac(t: Tables) -> DataFrame:
    return _matrix(t, "hac", k=10, linkage="ward")


@query()
def hdbscan(t: Tables) -> DataFrame:
    return _matrix(t, "hdbscan", least_size=10)


@query()
def adp(t: Tables) -> DataFrame:
    return _matrix(t, "adp", z=1.6)


@query()
def spectral(t: Tables) -> DataFrame:
    return _matrix(t, "spectral", k=10)


@query()
def merge_tree_jumps(t: Tables) -> DataFrame:
    return tree.jumps(tree.linkage_table(t.embeddings, "vec_id", "embedding", "average"), t.embeddings.count())


@query()
def logistic(t: Tables) -> DataFrame:
    c = t.customer.withColumn("y", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    return stats.logistic_vs_rest(c, "y", ["c_acctbal", "c_nationkey"])


@query("SELECT CAST(64 AS BIGINT) AS components, round(sum(v), 3) AS variance FROM (SELECT var_samp(CAST(x AS DOUBLE)) AS v FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)")
def dual_pca(t: Tables) -> DataFrame:
    """All axes together hold the variance of all components."""
    dual = reduce.DualPca.of_rows(t.embeddings, "vec_id", "embedding", 64)
    return t.spark.createDataFrame([(dual.kept, round(float(dual.values.sum()), 3))], "components long, variance double")


def priority_matrix(t: Tables) -> matrices.Matrix:
    long = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("feature")).agg(F.count(F.lit(1)).alias("value"))
    excluded = t.customer.filter("c_nationkey = 3").select("c_custkey")
    return matrices.build_matrix(long, t.customer.select("c_custkey", "c_acctbal"), "c_custkey", [("negative balance", F.col("c_acctbal") >= 0)], excluded)


IN = "c_acctbal >= 0 AND c_nationkey <> 3"


@query(f"SELECT c_custkey, CAST(count(*) AS DOUBLE) AS load, CAST(count(DISTINCT o_orderpriority) AS INT) AS filled FROM customer JOIN orders ON c_custkey = o_custkey WHERE {IN} GROUP BY 1")
def matrix_rows(t: Tables) -> DataFrame:
    m = priority_matrix(t)
    return m.rows.join(m.load, "c_custkey").select("c_custkey", "load", F.size("places").alias("filled"))


@query(f"SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_nationkey = 3 THEN 'excluded by list' ELSE 'not measured' END ELSE 'negative balance' END AS reason FROM customer WHERE NOT coalesce({IN}, false) OR c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'not registered' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def matrix_audit(t: Tables) -> DataFrame:
    return priority_matrix(t).audit


@query()
def tuning_sweep(t: Tables) -> DataFrame:
    e = t.embeddings.drop("label")
    swept = tuning.tuning_sweep(e, "vec_id", "embedding", "hac", {"k": [5, 10], "linkage": ["ward", "average"]})
    return rounded(swept.drop("params"))


@query()
def production_results(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").alias("x"))
    return rounded(production.hac_run(rows, 10, "ward")[0])
