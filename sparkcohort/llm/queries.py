"""Queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcohort.llm.crf import score_documents
from sparkcohort.llm.linededup import dedup_lines
from sparkcohort.llm.mixing import mix_sources
from sparkcohort.llm.mtree import top_k
from sparkcohort.llm.ngram import ngram_groups
from sparkcohort.llm.packing import pack_documents
from sparkcohort.llm.pii import KINDS, find_pii, span_text
from sparkcohort.llm.reputation import DEFAULT_SUFFIXES, judge_urls
from sparkcohort.llm.rules import score_quality
from sparkcohort.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(KINDS), 256).alias("base_sha256"), span_text((*KINDS, "secret")).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST(('0x' || substr(x, CAST(5 * (c // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (c % 4) AS BIGINT)) & 31 AS BIGINT), 1) FOR c IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", "words_left", "text")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS x FROM pages),
p AS (SELECT page_id, translate(split_part(x, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(x, length(split_part(x, '/', 1)) + 1) AS path FROM (SELECT page_id, coalesce(x, '') AS x FROM a)),
w AS (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS x, array_to_string(list_slice(string_split(regexp_replace(host, ':[0-9]*$', ''), '.'), -2, -1), '.') AS two FROM p),
g AS (SELECT page_id, host, path, CASE WHEN two IN ({suffixes}) THEN array_to_string(list_slice(x, -3, -1), '.') ELSE two END AS dom, CASE WHEN two IN ({suffixes}) THEN two ELSE list_extract(x, -1) END AS suf FROM w),
t AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT host, dom, suf, good FROM g JOIN t ON t.doc_id = TRY_CAST(regexp_extract(path, '^/[^/]+/([0-9]{1,18})(?:\\.html|/)?$', 1) AS BIGINT) WHERE host <> ''),
r AS (SELECT (1 + coalesce(sum(good), 0)) / (2.0 + count(*)) AS root FROM o),
s0 AS (SELECT suf, count(*) AS n, sum(good) AS k, (SELECT root FROM r) AS prior FROM o GROUP BY suf),
m0 AS (SELECT CASE WHEN spread > 0 THEN least(1000, greatest(2.0, w / spread - 1)) ELSE 1000 END AS m FROM (SELECT CASE WHEN sum(n) * sum(n) > sum(n * n) THEN (sum(n * (k / n - prior) ** 2) - (count(*) - 1) * (SELECT root * (1 - root) FROM r)) / (sum(n) - sum(n * n) / sum(n)) ELSE 0 END AS spread, (SELECT root * (1 - root) FROM r) AS w FROM s0)),
s1 AS (SELECT suf, (m * prior + k) / (m + n) AS mean FROM s0, m0),
d0 AS (SELECT o.suf, dom, count(*) AS n, sum(good) AS k, any_value(s1.mean) AS prior FROM o JOIN s1 USING (suf) GROUP BY o.suf, dom),
m1 AS (SELECT CASE WHEN spread > 0 THEN least(1000, greatest(2.0, w / spread - 1)) ELSE 1000 END AS m FROM (SELECT CASE WHEN sum(n) * sum(n) > sum(n * n) THEN (sum(n * (k / n - prior) ** 2) - (count(*) - 1) * (SELECT root * (1 - root) FROM r)) / (sum(n) - sum(n * n) / sum(n)) ELSE 0 END AS spread, (SELECT root * (1 - root) FROM r) AS w FROM d0)),
d1 AS (SELECT dom, (m * prior + k) / (m + n) AS mean FROM d0, m1),
h0 AS (SELECT host, count(*) AS n, sum(good) AS k, any_value(d1.mean) AS prior FROM o JOIN d1 USING (dom) GROUP BY host),
m2 AS (SELECT CASE WHEN spread > 0 THEN least(1000, greatest(2.0, w / spread - 1)) ELSE 1000 END AS m FROM (SELECT CASE WHEN sum(n) * sum(n) > sum(n * n) THEN (sum(n * (k / n - prior) ** 2) - (count(*) - 1) * (SELECT root * (1 - root) FROM r)) / (sum(n) - sum(n * n) / sum(n)) ELSE 0 END AS spread, (SELECT root * (1 - root) FROM r) AS w FROM h0)),
h1 AS (SELECT host, m * prior + k AS alpha, m * (1 - prior) + n - k AS beta FROM h0, m2),
j AS (SELECT g.page_id, g.host, g.path, coalesce(h1.alpha, (SELECT m FROM m2) * coalesce(d1.mean, s1.mean, (SELECT root FROM r))) AS alpha,
  coalesce(h1.beta, (SELECT m FROM m2) * (1 - coalesce(d1.mean, s1.mean, (SELECT root FROM r)))) AS beta
  FROM g LEFT JOIN h1 ON g.host = h1.host LEFT JOIN d1 ON g.dom = d1.dom LEFT JOIN s1 ON g.suf = s1.suf),
b AS (SELECT *, alpha / (alpha + beta) - 1.645 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS bound,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM j)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound >= 0.75 THEN 'allow' ELSE 'block' END AS verdict
FROM b
""".replace("{suffixes}", ", ".join(f"'{x}'" for x in DEFAULT_SUFFIXES))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"), share=75).select("doc_id", "n_shingles", "component_id")


OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT r.root, l.y FROM r JOIN l ON r.node = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_rules": op2_rules,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_urls": op7_urls,
    "op8_packing": op8_packing,
    "op9_ngram_join": op9_ngram_join,
    "op10_topk": op10_topk,
}
ORACLES: dict[str, str] = {
    "op5_warc": OP5_SQL,
    "op7_urls": OP7_SQL,
    "op9_ngram_join": OP9_SQL,
    "op10_topk": OP10_SQL,
}
