"""More registered queries with their DuckDB oracles: scalars, write rules, sweeps, trees, maps and voxel grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.functions import scalars as S
from sparkcohort.operators import checks, compare, describe, pairs, prediction, reduce, relational, reshape, spatial, sweep, tree, validity
from sparkcohort.plans import evaluations
from sparkcohort.plans.catalog import BOTH, D, Tables, embedding_labels, embedding_pairs, embedding_sums, query, r, rounded


@query("SELECT c_custkey, CASE WHEN substr(c_name, 10, 2) = '00' THEN 'early' ELSE 'late' END AS grp, CASE WHEN c_mktsegment IN ('BUILDING', '') THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) ELSE 'fraction' END AS whole, CASE WHEN c_nationkey - 1 = -1 THEN 'noise' ELSE CAST(c_nationkey - 1 AS VARCHAR) END AS cluster, 'c_' || CAST(c_custkey AS VARCHAR) AS tag FROM (SELECT c_custkey, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS c_name, c_mktsegment, c_acctbal, c_nationkey FROM customer)")
def subject_scalars(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    whole = F.when(F.col("c_acctbal") == F.floor("c_acctbal"), S.plain_number(F.col("c_acctbal"))).otherwise("fraction")
    return t.customer.select("c_custkey", S.group_of(name, r"^Customer#(\d{2})\d+$", {"00": "early"}, "late").alias("grp"), S.missing_to_null(F.col("c_mktsegment"), ("", "BUILDING")).alias("segment"), whole.alias("whole"), S.cluster_name(F.col("c_nationkey") - 1).alias("cluster"), S.joined_tag(F.lit("c"), F.lit(None).cast("string"), F.col("c_custkey").cast("string")).alias("tag"))


@query("SELECT o_orderkey, translate(format('{:,.2f}', CAST(o_totalprice AS DOUBLE)), ',.', '.,') AS price, replace(printf('%.9e', CAST(o_totalprice AS DOUBLE)), '.', ',') AS scientific FROM orders")
def number_formats(t: Tables) -> DataFrame:
    p = F.col("o_totalprice").cast("double")
    return t.orders.select("o_orderkey", S.comma_number(p, 2).alias("price"), S.comma_scientific(p, 9).alias("scientific"))


@query("SELECT event_id, list_transform(range(CAST(floor(log10(1.0 + event_id % 97)) AS BIGINT), CAST(ceil(log10(7.0 + event_id % 9973)) AS BIGINT) + 1), lambda e: CAST(pow(10.0, e) AS DOUBLE)) AS ticks FROM events WHERE floor(log10(1.0 + event_id % 97)) <= ceil(log10(7.0 + event_id % 9973))")
def log_decade_ticks(t: Tables) -> DataFrame:
    low, high = F.lit(1.0) + F.col("event_id") % 97, F.lit(7.0) + F.col("event_id") % 9973
    return t.events.filter(F.floor(F.log10(low)) <= F.ceil(F.log10(high))).select("event_id", S.decades(low, high).alias("ticks"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ' 01:02:03' AS at, CAST((o_orderkey % 400000) // 3600 AS VARCHAR) || ':' || lpad(CAST((o_orderkey % 400000) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS took FROM (SELECT o_orderdate, o_orderkey FROM orders WHERE o_orderkey < 400000 AND year(o_orderdate) >= 2000)")
def run_times(t: Tables) -> DataFrame:
    name = F.concat(F.lit("clustering__"), F.date_format("o_orderdate", "dd-MM-yy"), F.lit("__01-02-03.log"))
    start = S.run_time(name)
    return t.orders.filter("o_orderkey < 400000 AND year(o_orderdate) >= 2000").select("o_orderkey", F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("at"), S.elapsed(start, (start.cast("long") + F.col("o_orderkey")).cast("timestamp")).alias("took"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.03 THEN 'some' ELSE 'low' END AS level FROM lineitem")
def reading_levels(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", S.reading_level(F.col("l_discount"), (0.03, 0.08), ("low", "some", "high")).alias("level"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_brand AS brand FROM part")
def parse_combo_key(t: Tables) -> DataFrame:
    keyed = t.part.withColumn("m", S.parse_combo_key(S.combo_key(["p_size", "p_brand"])))
    return keyed.select("p_partkey", F.col("m")["p_size"].alias("size"), F.col("m")["p_brand"].alias("brand"))


@query("SELECT count(*) AS n, count(*) FILTER (p_size >= 25) AS ones FROM part")
def value_checks(t: Tables) -> DataFrame:
    big = checks.values_in_range(checks.finite_numeric(t.part, "p_partkey", "p_retailprice"), "p_retailprice", 0, 1e6).withColumn("big", (F.col("p_size") >= 25).cast("int"))
    return checks.binary_values(checks.closed_vocabulary(big, "big", [0, 1]), "big").agg(F.count(F.lit(1)).alias("n"), F.sum("big").alias("ones"))


@query("SELECT o_orderkey, CASE WHEN n_nationkey < 20 THEN CAST(c_acctbal AS DOUBLE) END AS balance, CASE WHEN c_nationkey < 20 AND c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE 'unknown' END AS segment FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def registry_lookup(t: Tables) -> DataFrame:
    known = t.customer.filter("c_nationkey < 20").select("c_custkey", F.col("c_acctbal").alias("balance"), F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")).alias("segment"))
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return relational.lookup(relational.lookup(o, known, "c_custkey", "balance", numeric=True), known, "c_custkey", "segment").drop("c_custkey")


@query("WITH f AS (SELECT DISTINCT s_suppkey FROM supplier ORDER BY 1 LIMIT 7) SELECT s_suppkey, s_suppkey IN (SELECT s_suppkey FROM f) OR s_suppkey IN (9, 10) AS chosen FROM supplier")
def sample_split(t: Tables) -> DataFrame:
    chosen, rest = relational.split_sample(t.supplier, "s_suppkey", 7, [9, 10])
    return chosen.withColumn("chosen", F.lit(True)).unionByName(rest.withColumn("chosen", F.lit(False)))


@query("SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def common_keys(t: Tables) -> DataFrame:
    return relational.in_every_group(t.lineitem, "l_suppkey", "l_linenumber")


@query("WITH n AS (SELECT c_nationkey AS i, c_mktsegment AS s, count(*) AS m FROM customer GROUP BY 1, 2), q AS (SELECT a.i, b.i AS j, CAST(sum(a.m * b.m) AS BIGINT) AS w FROM n a JOIN n b USING (s) GROUP BY 1, 2) SELECT i, j, CASE WHEN i % 5 <> 0 AND j % 5 <> 0 THEN w END AS w FROM q")
def masked_nodes(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("m"))
    a, b = (n.select("c_mktsegment", F.col("c_nationkey").alias(s), F.col("m").alias(f"m{s}")) for s in "ij")
    square = a.join(b, "c_mktsegment").groupBy("i", "j").agg(F.sum(F.col("mi") * F.col("mj")).alias("w"))
    return reshape.mask_nodes(square, t.nation.filter("n_nationkey % 5 = 0"), "n_nationkey", "i", "j", "w")


@query("SELECT p_brand, round(avg(CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM part GROUP BY 1")
def parcel_coverage(t: Tables) -> DataFrame:
    damaged = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return rounded(reshape.coverage(t.part.select("p_partkey", "p_brand"), damaged, "p_partkey", "p_brand"))


@query("SELECT l_partkey, round(sum(CAST(l_quantity AS DOUBLE)) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS mean FROM lineitem GROUP BY 1")
def mean_map(t: Tables) -> DataFrame:
    n = t.lineitem.select("l_orderkey").distinct().count()
    return rounded(reshape.mean_map(t.lineitem, "l_partkey", "l_quantity", n))


@query("SELECT vec_id, [round(CAST(x AS DOUBLE), 5) FOR x IN embedding] AS x FROM embeddings")
def stacked_vectors(t: Tables) -> DataFrame:
    long = reshape.explode_features(t.embeddings, "vec_id", "embedding").withColumn("value", r(F.col("value").cast("double"), 5))
    return reshape.feature_arrays(long, "vec_id")


WRITE = "WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'seg' || (c_custkey % 4) END AS v FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS s FROM customer), j AS (SELECT o.*, v, c_nationkey < 20 AND c_custkey % 7 <> 0 AS free FROM o LEFT JOIN f USING (c_custkey)) SELECT c_custkey, "


def _written(t: Tables, overwrite: bool) -> DataFrame:
    fresh = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("seg"), (F.col("c_custkey") % 4).cast("string"))).alias("segment"))
    rows = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    out = relational.write_column(rows, fresh, "c_custkey", "segment", in_scope=F.col("c_nationkey") < 20, protected=F.col("c_custkey") % 7 == 0, overwrite=overwrite)
    return out.select("c_custkey", "segment", F.col("_conflict").alias("conflict"))


@query(WRITE + "CASE WHEN free THEN coalesce(s, v) ELSE s END AS segment, coalesce(free AND s <> v, false) AS conflict FROM j")
def write_column_append(t: Tables) -> DataFrame:
    return _written(t, False)


@query(WRITE + "CASE WHEN free THEN coalesce(v, s) ELSE s END AS segment, false AS conflict FROM j")
def write_column_overwrite(t: Tables) -> DataFrame:
    return _written(t, True)


@query("SELECT s_suppkey, s_nationkey, CAST(2 * s_nationkey AS DOUBLE) AS score FROM supplier")
def owned_columns(t: Tables) -> DataFrame:
    old = t.supplier.select("s_suppkey", "s_nationkey", F.lit(0.0).alias("score"))
    return relational.merge_columns(old, t.supplier.select("s_suppkey", (2.0 * F.col("s_nationkey")).alias("score")), ["s_suppkey"], ["score"])


@query("SELECT vec_id, CASE WHEN label % 4 = 0 THEN 'noise ' || vec_id ELSE CAST(label AS VARCHAR) END AS label FROM embeddings")
def noise_singletons(t: Tables) -> DataFrame:
    noisy = t.embeddings.select("vec_id", F.when(F.col("label") % 4 == 0, -1).otherwise(F.col("label")).alias("label"))
    return compare.noise_as_singletons(noisy, "label", "vec_id")


@query("SELECT g AS \"group\", count(v) AS n_available, count(*) AS n_total, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (SELECT c_custkey, unnest(['nation ' || c_nationkey, c_mktsegment]) AS g, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) END AS v FROM customer) GROUP BY g")
def overlapping_group_stats(t: Tables) -> DataFrame:
    members = t.customer.select("c_custkey", F.explode(F.array(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), F.col("c_mktsegment"))).alias("group_id"))
    return rounded(describe.group_summary(t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v")), members, "c_custkey", "v"))


MEMBERSHIP = "m AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN -1 ELSE CAST(vec_id % 3 AS INT) END AS l, [CAST((vec_id * 7 + 3 * c) % 10 AS DOUBLE) / 10 FOR c IN range(0, 3)] AS p FROM embeddings)"


def _memberships(t: Tables) -> DataFrame:
    p = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: ((F.col("vec_id") * 7 + 3 * c) % 10).cast("double") / 10)
    return t.embeddings.select("vec_id", F.when(F.col("vec_id") % 11 == 0, -1).otherwise((F.col("vec_id") % 3).cast("int")).alias("label"), p.alias("p"))


@query(f"WITH {MEMBERSHIP}, x AS (SELECT l, c, count(*) AS n, avg(p[c + 1]) AS mean FROM m, (SELECT unnest(range(0, 3)) AS c) WHERE l <> -1 GROUP BY 1, 2), o AS (SELECT l, c, mean, row_number() OVER (PARTITION BY l ORDER BY round(mean, 9) DESC, c) AS k FROM x WHERE c <> l) SELECT x.l AS label, n, round(x.mean, 6) AS own_mean, CAST(o.c AS INT) AS best_other, round(o.mean, 6) AS best_other_mean FROM x JOIN o ON o.l = x.l AND k = 1 WHERE x.c = x.l")
def soft_membership(t: Tables) -> DataFrame:
    return rounded(describe.membership_summary(_memberships(t), "label", "p"))


@query(f"WITH {MEMBERSHIP} SELECT vec_id, CASE WHEN l <> -1 THEN round(p[l + 1], 6) END AS own FROM m")
def own_membership(t: Tables) -> DataFrame:
    return _memberships(t).select("vec_id", r(describe.own_membership("label", "p")).alias("own"))


SWEPT = "u AS (SELECT vec_id, unnest([2, 3, 5]) AS k FROM embeddings), s AS (SELECT CAST(k AS INT) AS k, vec_id, CASE WHEN vec_id % 13 = 0 THEN -1 ELSE CAST(vec_id * vec_id % k AS INT) END AS l FROM u)"


def _swept(t: Tables) -> DataFrame:
    u = t.embeddings.select("vec_id", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))).alias("k"))
    return u.select("k", "vec_id", F.when(F.col("vec_id") % 13 == 0, -1).otherwise((F.col("vec_id") * F.col("vec_id") % F.col("k")).cast("int")).alias("label"))


@query(f"WITH {SWEPT}, c AS (SELECT k, l, count(*) AS m FROM s GROUP BY 1, 2) SELECT k, round(max(m) FILTER (l <> -1) / CAST(sum(m) AS DOUBLE), 6) AS largest_share FROM c GROUP BY k")
def largest_cluster_share(t: Tables) -> DataFrame:
    return rounded(sweep.largest_share(_swept(t), "k", "label"))


@query(f"WITH {SWEPT}, j AS (SELECT a.k, a.l AS a, b.l AS b, CAST(count(*) AS DOUBLE) AS n FROM s a JOIN s b ON a.vec_id = b.vec_id AND (a.k, b.k) IN ((3, 2), (5, 3)) GROUP BY 1, 2, 3), t AS (SELECT k, sum(n) AS t, sum(n * (n - 1) / 2) AS ab FROM j GROUP BY k), x AS (SELECT k, sum(m * (m - 1) / 2) AS pa FROM (SELECT k, a, sum(n) AS m FROM j GROUP BY 1, 2) GROUP BY k), y AS (SELECT k, sum(m * (m - 1) / 2) AS pb FROM (SELECT k, b, sum(n) AS m FROM j GROUP BY 1, 2) GROUP BY k) SELECT 'z' AS g, k, round((ab - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari FROM t JOIN x USING (k) JOIN y USING (k)")
def ari_along_sweep(t: Tables) -> DataFrame:
    return rounded(sweep.ari_against_previous(_swept(t).withColumn("g", F.lit("z")), ["g"], "k", "vec_id", "label"))


@query("WITH g AS (SELECT k, m FROM (SELECT CAST(unnest([2, 3, 4]) AS INT) AS k), (SELECT unnest(['a', 'b']) AS m)) SELECT 'k' AS axis, k, m FROM g WHERE m = 'a' UNION ALL SELECT 'm', k, m FROM g WHERE k = 3")
def one_axis_slices(t: Tables) -> DataFrame:
    return sweep.one_axis_slices(sweep.combo_grid(t.spark, {"k": [2, 3, 4], "m": ["a", "b"]}), {"k": 3, "m": "a"}, ["k", "m"]).select("axis", "k", "m")


@query("SELECT 'k=' || k AS combo_key, CASE WHEN k = 9 THEN 'not stored' ELSE 'not expected' END AS side FROM (SELECT 9 AS k UNION SELECT DISTINCT p_size FROM part WHERE p_size > 9 AND p_size < 14)")
def missing_combos(t: Tables) -> DataFrame:
    stored = t.part.filter("p_size < 14 AND p_size <> 9").select(F.concat(F.lit("k="), F.col("p_size").cast("string")).alias("combo_key"))
    expected = sweep.combo_grid(t.spark, {"k": [9]}).select("combo_key").unionByName(stored.filter("combo_key IN ('k=1','k=2','k=3','k=4','k=5','k=6','k=7','k=8')"))
    return sweep.missing_combos(expected, stored)


def _chain(t: Tables) -> DataFrame:
    """A merge tree over the nations: each joins the ones before it, at rising heights."""
    m = F.col("n_nationkey")
    return t.nation.filter("n_nationkey < 24").select(F.lit("all").alias("tree"), m.cast("long").alias("merge"), F.when(m == 0, 0).otherwise(24 + m).cast("long").alias("left"), (m + 1).cast("long").alias("right"), ((m + 1) * (m + 2) / 4.0).alias("height"), (m + 2).cast("long").alias("size"))


CHAIN = "h AS (SELECT n_nationkey AS m, (n_nationkey + 1) * (n_nationkey + 2) / 4.0 AS h FROM nation WHERE n_nationkey < 24)"


@query(f"WITH {CHAIN} SELECT 'all' AS tree, CAST(25 - b.m AS BIGINT) AS k, round(b.h / a.h, 6) AS jump FROM h a JOIN h b ON b.m = a.m + 1")
def tree_jumps(t: Tables) -> DataFrame:
    return rounded(tree.jumps(_chain(t), 25))


@query(f"WITH {CHAIN} SELECT 'all' AS tree, CAST(24 - a.m AS BIGINT) AS k, round((a.h + b.h) / 2, 6) AS cut FROM h a JOIN h b ON b.m = a.m + 1")
def tree_cut_heights(t: Tables) -> DataFrame:
    return rounded(tree.cut_heights(_chain(t), 25))


@query("SELECT 'all' AS tree, CAST(25 - n_nationkey AS BIGINT) AS k, CAST(25 + n_nationkey AS BIGINT) AS parent, CAST(CASE WHEN n_nationkey = 0 THEN 0 ELSE 24 + n_nationkey END AS BIGINT) AS child_1, CAST(n_nationkey + 1 AS BIGINT) AS child_2 FROM nation WHERE n_nationkey < 24")
def tree_splits(t: Tables) -> DataFrame:
    return tree.splits(_chain(t), 25)


@query("WITH c AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY v DESC, p_brand) AS rank, sum(v) OVER (ORDER BY v DESC, p_brand) / (SELECT sum(v) FROM c) AS cumulative FROM c) SELECT CAST(min(rank) AS INT) AS n_components FROM o WHERE cumulative >= 0.6 - 1e-12")
def components_for_share(t: Tables) -> DataFrame:
    brands = t.part.groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    return describe.components_for_share(describe.cumulative_share(brands, "p_brand", "v"), 0.6)


@query("WITH v AS (SELECT list_sort(list(DISTINCT p_size)) AS v FROM part) SELECT list_distinct([v[1], v[len(v) // 2 + 1], v[len(v)]]).list_sort() AS \"values\" FROM v")
def representative_values(t: Tables) -> DataFrame:
    return describe.representative_values(t.part, "p_size")


@query("SELECT p_brand, p_partkey, CAST(k AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def top_rows(t: Tables) -> DataFrame:
    return describe.top_per_group(t.part, ["p_brand"], "p_retailprice", 3, ["p_partkey"]).select("p_brand", "p_partkey", "place")


@query("SELECT c_mktsegment AS value, CAST(row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_mktsegment) AS INT) AS place FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def ordered_values(t: Tables) -> DataFrame:
    return describe.ordered_values(t.customer, "c_mktsegment", ["MACHINERY", "BUILDING"])


@query("WITH s AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS f FROM lineitem WHERE l_quantity > 25), z AS (SELECT k, count(*) AS n FROM s GROUP BY k), p AS (SELECT a.k AS i, b.k AS j, count(*) AS m FROM s a JOIN s b ON a.f = b.f AND a.k < b.k GROUP BY 1, 2) SELECT round(avg(CASE WHEN m IS NULL THEN 1.0 ELSE 0.0 END), 6) AS saturated_share FROM z x JOIN z y ON x.k < y.k LEFT JOIN p ON i = x.k AND j = y.k")
def saturated_share(t: Tables) -> DataFrame:
    return rounded(pairs.saturated_sets(t.lineitem.filter("l_quantity > 25"), "l_suppkey", "l_partkey"))


GRID = "v AS (SELECT CAST(p_partkey % 3 AS INT) AS subject, p_partkey // 3 % 6 AS i, p_partkey // 18 % 5 AS j, p_partkey // 90 % 4 AS k, CAST(max(p_size) AS DOUBLE) AS value FROM part GROUP BY ALL)"
SOURCE, TARGET = np.diag([2.0, 2.0, 2.0, 1.0]), np.diag([1.0, 1.0, 1.0, 1.0])
SOURCE[:3, 3] = (-5.0, 0.0, 0.0)
TARGET[:3, 3] = (-5.0, 0.0, 0.0)


def _voxels(t: Tables) -> DataFrame:
    at = lambda d, m: F.expr(f"p_partkey div {d} % {m}")
    return t.part.select((F.col("p_partkey") % 3).cast("int").alias("subject"), at(3, 6).alias("i"), at(18, 5).alias("j"), at(90, 4).alias("k"), "p_size").groupBy("subject", "i", "j", "k").agg(F.max("p_size").cast("double").alias("value"))


@query(f"WITH {GRID}, g AS (SELECT a.i, b.j, c.k FROM (SELECT unnest(range(0, 12)) AS i) a, (SELECT unnest(range(0, 10)) AS j) b, (SELECT unnest(range(0, 8)) AS k) c) SELECT subject, g.i, g.j, g.k, value FROM g JOIN v ON v.i = floor(g.i / 2.0 + 0.5) AND v.j = floor(g.j / 2.0 + 0.5) AND v.k = floor(g.k / 2.0 + 0.5)")
def resampled_voxels(t: Tables) -> DataFrame:
    return spatial.resample_nearest(_voxels(t), SOURCE, (12, 10, 8), TARGET)


@query(f"WITH {GRID}, b AS (SELECT *, 2 * i - 5 AS x, i + j < 8 AS inside FROM v WHERE value > 20) SELECT subject, count(*) FILTER (inside) AS volume, round(avg(CASE WHEN inside THEN 0.0 ELSE 1.0 END), 6) AS out_of_brain_fraction, count(*) FILTER (inside AND x < 0) AS \"left\", count(*) FILTER (inside AND x > 0) AS \"right\" FROM b GROUP BY subject")
def lesion_metrics(t: Tables) -> DataFrame:
    brain = t.spark.range(120).select(F.expr("id div 20").alias("i"), F.expr("id div 4 % 5").alias("j"), (F.col("id") % 4).alias("k")).filter("i + j < 8")
    return rounded(spatial.lesion_metrics(spatial.binarize(_voxels(t), 20), SOURCE, brain))


@query(f"WITH {GRID} SELECT subject, CAST((i * 5 + j) * 4 + k AS BIGINT) AS voxel, CASE WHEN value > 40 THEN 'core' WHEN i + j < 4 THEN 'deep' ELSE 'rest' END AS category, CASE WHEN 2 * i - 5 < 0 THEN 'left' ELSE 'right' END AS side FROM v")
def voxel_categories(t: Tables) -> DataFrame:
    placed = spatial.location_categories(_voxels(t), [("core", F.col("value") > 40), ("deep", F.col("i") + F.col("j") < 4)], "rest")
    return placed.select("subject", spatial.voxel_id(F.col("i"), F.col("j"), F.col("k"), (6, 5, 4)).cast("long").alias("voxel"), "category", spatial.hemisphere(SOURCE).alias("side"))


@query(f"WITH {GRID} SELECT subject, round(avg(2.0 * i - 5), 6) AS x FROM v GROUP BY subject")
def centroid_sides(t: Tables) -> DataFrame:
    return rounded(spatial.centroid_sides(_voxels(t), SOURCE, "subject"))


@query("SELECT round(pow(corr(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)), 2), 6) AS r2 FROM lineitem")
def prediction_accuracy(t: Tables) -> DataFrame:
    return rounded(prediction.accuracy(t.lineitem.select(F.col("l_extendedprice").cast("double").alias("truth"), F.col("l_quantity").cast("double").alias("predicted"))))


@query("WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS c, unnest(embedding) AS v FROM embeddings), y AS (SELECT a.c, CAST(a.v AS DOUBLE) AS x, CAST(b.v AS DOUBLE) AS y FROM x a JOIN x b ON b.vec_id = a.vec_id + 1 AND a.c = b.c WHERE a.c < 5) SELECT CAST(c AS INT) AS component, round(corr(x, y), 6) AS correlation FROM y GROUP BY c")
def map_reproducibility(t: Tables) -> DataFrame:
    maps = t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("t"))
    return rounded(reduce.map_reproducibility(maps, maps.withColumn("vec_id", F.col("vec_id") - 1), "vec_id"))


RUN_CATALOG = "c AS (SELECT p_partkey AS run_id, p_brand AS modality, p_size % 3 AS method, p_size % 2 AS params FROM part)"


@query(f"WITH {RUN_CATALOG} SELECT b.run_id, b.modality, b.method, b.params FROM c a JOIN c b ON a.run_id = (SELECT min(run_id) FROM c) AND a.modality <> b.modality AND a.method = b.method AND a.params = b.params")
def comparable_runs(t: Tables) -> DataFrame:
    runs = t.part.select(F.col("p_partkey").alias("run_id"), F.col("p_brand").alias("modality"), (F.col("p_size") % 3).alias("method"), (F.col("p_size") % 2).alias("params"))
    return evaluations.compatible_runs(runs, runs.agg(F.min("run_id")).first()[0])


@query("SELECT * FROM (SELECT p_brand, p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 5")
def best_combinations(t: Tables) -> DataFrame:
    ranked = evaluations.best(t.part.select("p_brand", "p_partkey", "p_retailprice"), "p_retailprice", n=5, ties=("p_partkey",))
    return describe.top_per_group(ranked.withColumn("g", F.lit(1)), ["g"], "p_retailprice", 5, ["p_partkey"]).select("p_brand", "p_partkey", F.col("place").cast("long").alias("k"))


EVALUATED = f"{D}, {BOTH}, m AS (SELECT i, li, lj, avg(d) AS m FROM w GROUP BY 1, 2, 3), a AS (SELECT i, max(m) FILTER (li = lj) AS a, min(m) FILTER (li <> lj) AS b FROM m GROUP BY i)"


@query(f"WITH {EVALUATED}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT 'k=' || 1 AS combo, (SELECT count(*) FROM n) AS clusters, CAST(0 AS DOUBLE) AS noise_fraction, round((SELECT max(n) / CAST(sum(n) AS DOUBLE) FROM n), 6) AS largest_share, round(avg(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM a")
def evaluated_sweep(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").alias("x"))
    return rounded(evaluations.evaluate_sweep_rows(rows, embedding_labels(t).withColumn("combo", F.lit("k=1")), "combo", ["k=1"]))


@query(f"WITH {EVALUATED}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT 'n' AS metric, round(CAST(sum(n) AS DOUBLE), 6) AS value FROM n UNION ALL SELECT 'clusters', count(*) FROM n UNION ALL SELECT 'noise', 0 UNION ALL SELECT 'noise_fraction', 0 UNION ALL SELECT 'largest_share', round(max(n) / CAST(sum(n) AS DOUBLE), 6) FROM n UNION ALL SELECT 'dunn', round((SELECT min(d) FROM d WHERE li <> lj) / (SELECT max(d) FROM d WHERE li = lj), 6)")
def evaluated_partition(t: Tables) -> DataFrame:
    return rounded(evaluations.evaluate(embedding_pairs(t), embedding_labels(t), ["dunn"]).select("metric", "value"))


@query(f"WITH {EVALUATED}, s AS (SELECT li, count(*) AS n, count(*) FILTER (b < a) AS worse FROM a JOIN (SELECT DISTINCT i AS x, li FROM m) ON x = i GROUP BY li) SELECT li AS label, n, worse FROM s")
def misplaced_members(t: Tables) -> DataFrame:
    samples = validity.silhouette_of_sums(embedding_sums(t))
    by = describe.silhouette_breakdown(samples)
    return by.select("label", "n", F.round(F.col("negative_share") * F.col("n")).cast("long").alias("worse"))
