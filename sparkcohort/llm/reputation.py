"""URL filters: rules by host and path, else empirical-Bayes reputation of hosts.

Labelled pages are outcomes of their hosts. A beta prior goes down from all pages to suffix, registered domain
(suffix and one label before it) and host; each level's strength is estimated from how its groups spread about
their parents (method of moments), so a host with few outcomes lies near its domain. A page is allowed where the
lower posterior bound of its host is at least the threshold. Outcomes are counted by host once; all else is done on
hosts, and pages are read once more for the bound of theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path)
DEFAULT_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels below which names are registered; every other suffix is the last label.
DEFAULT_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.uk")
#: Hosts whose bounds are broadcast at most; beyond that Spark joins by shuffle.
MOST_BROADCAST = 1_000_000
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; empty for a null url or one without ://."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)).otherwise("")
    after = F.coalesce(F.substring_index(after, "?", 1), F.lit(""))
    host = F.substring_index(after, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(after, F.length(host) + 1, F.length(after) + 1)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, at = text.split("/", 1)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{at}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def host_groups(host: Column, suffixes: Sequence[str] = DEFAULT_SUFFIXES) -> tuple[Column, Column]:
    """Suffix (last label, or two of `suffixes`) and registered domain (one label more) of a host, without its port."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1)), F.when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def posteriors(outcomes: DataFrame, most_strength: float = 1000.0, suffixes: Sequence[str] = DEFAULT_SUFFIXES) -> tuple[DataFrame, dict]:
    """host, alpha, beta of hosts with outcomes. outcomes: host, good (0 or 1). Also the tables of the levels above."""
    suffix, domain = host_groups(F.col("host"), suffixes)
    hosts = cut(outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k")), "hosts").withColumns({"suffix": suffix, "domain": domain})
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = (1 + (total["k"] or 0)) / (2 + (total["n"] or 0))
    tables: dict = {"root": root}
    parent = None
    for level in LEVELS:
        keys = list(LEVELS[: LEVELS.index(level) + 1])
        own = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if parent is None:
            own = own.withColumn("prior", F.lit(root))
        else:
            up = keys[-2]
            own = own.join(parent.select(F.col(up).alias("up"), F.col("mean").alias("prior")), F.col(up) == F.col("up")).drop("up")
        s = own.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("prior")) ** 2).alias("ss")).first()
        within = root * (1 - root)
        spread = (s["ss"] - (s["g"] - 1) * within) / (s["n"] - s["nn"] / s["n"]) if s["n"] and s["n"] ** 2 > s["nn"] else 0.0
        strength = min(most_strength, max(2.0, within / spread - 1)) if spread > 0 else most_strength
        own = own.withColumn("alpha", strength * F.col("prior") + F.col("k")).withColumn("beta", strength * (1 - F.col("prior")) + F.col("n") - F.col("k"))
        parent = own.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
        tables[level], tables[f"{level}_strength"] = parent, strength
    return parent.select("host", "alpha", "beta"), tables


def judge_urls(pages: DataFrame, labels: DataFrame, *, page_id: str = "page_id", url: str = "url", doc_id: str = "doc_id", quality: str = "quality", rules: Sequence[tuple[str, str]] = DEFAULT_RULES, suffixes: Sequence[str] = DEFAULT_SUFFIXES, threshold: float = 0.75, z: float = 1.645) -> DataFrame:
    """Verdict on every page's url: the longest rule's, else by its host's posterior bound.

    A page's outcome is the label of the document that its path names (/lang/number, with .html or / after it).
    Returns page_id, host, path, rule, verdict, bound. A null or odd url has empty host and path and is judged by
    the prior of all pages; a host without outcomes by its domain's, its suffix's or that prior. Repeated labels of
    a document count once (the lowest); null labels not at all; rows alike are judged alike; empty tables give the
    prior 1/2 or no rows; other columns are not read.
    """
    host, path = url_parts(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    named = p.withColumn("did", F.regexp_extract("path", r"^/[^/]+/([0-9]{1,18})(?:\.html|/)?$", 1)).filter("did <> '' and host <> ''").select("host", F.col("did").cast("long").alias("did"))
    told = labels.filter(F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("told_id")).agg(F.min(quality).cast("long").alias("good"))
    best, tables = posteriors(named.join(told, F.col("did") == F.col("told_id")).select("host", "good"), suffixes=suffixes)
    root, strength = tables["root"], tables["host_strength"]
    suffix, domain = host_groups(F.col("host"), suffixes)
    j = p.select("host").distinct().join(best.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").withColumns({"suffix": suffix, "domain": domain})
    for level in ("domain", "suffix"):
        t = tables[level].select(F.col(level).alias(f"{level}_key"), F.col("mean").alias(f"{level}_mean"))
        j = j.join(t, F.col(level) == F.col(f"{level}_key"), "left")
    prior = F.coalesce("domain_mean", "suffix_mean", F.lit(root))
    alpha = F.coalesce("alpha", F.lit(strength) * prior)
    beta = F.coalesce("beta", F.lit(strength) * (1 - prior))
    n = alpha + beta
    bounds = cut(j.select(F.col("host").alias("of_host"), (alpha / n - z * F.sqrt(alpha * beta / (n * n * (n + 1)))).alias("bound")), "host-bounds")
    bounds = F.broadcast(bounds) if bounds.count() <= MOST_BROADCAST else bounds
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    j = p.join(bounds, F.col("host") == F.col("of_host")).withColumns({"rule": rule, "ruled": verdict})
    return j.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bound") >= threshold, "allow").otherwise("block")).alias("verdict"), "bound")
