"""Readers: every table with an explicit schema, ids and dates as text, one scan for many files."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sparkcohort.functions.scalars import missing_to_null, nan_to_null
from sparkcohort.operators.checks import closed_vocabulary, known_keys, required_columns, strict_boolean, unique_key

FLAGS = ("has_lesion", "has_sdc", "has_features")
REGISTRY = ("subject_id", "original_id", "dataset", *FLAGS)


def text_table(spark: SparkSession, path: str | Sequence[str], separator: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as text; without given columns, the header of the first line names them."""
    reader = spark.read.option("header", True).option("sep", separator).option("inferSchema", False).option("enforceSchema", False)
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.csv(path if isinstance(path, str) else list(path))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """One row a subject, all text but the has_ flags, which must read True or False."""
    df = required_columns(text_table(spark, path), REGISTRY, "registry")
    df = unique_key(df, ["subject_id"], "registry")
    return df.withColumns({f: strict_boolean(F.col(f)) for f in FLAGS})


def measurements(spark: SparkSession, path: str, key: str = "subject_id") -> DataFrame:
    """key, metric, value in the long form; empty cells and NaN are null. A non-numeric cell raises."""
    df = unique_key(text_table(spark, path), [key], "measurements")
    names = [c for c in df.columns if c != key]
    long = df.unpivot([key], names, "metric", "value")
    v = missing_to_null(F.col("value"))
    bad = long.filter(v.isNotNull() & v.try_cast("double").isNull())
    if not bad.isEmpty():
        raise ValueError(f"measurements: not a number: {[tuple(r) for r in bad.limit(5).collect()]}")
    return long.withColumn("value", nan_to_null(v.try_cast("double")))


def exclusions(spark: SparkSession, path: str, reasons: Sequence[str], scopes: Sequence[str], scope: str | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """The whole list is validated before it is filtered to a scope (and to `all`)."""
    df = required_columns(text_table(spark, path), ("subject_id", "dataset", "reason", "scope", "value"), "exclusions")
    closed_vocabulary(df, "reason", reasons)
    closed_vocabulary(df, "scope", [*scopes, "all"])
    unique_key(df, ["subject_id", "scope"], "exclusions")
    both = df.groupBy("subject_id").agg(F.count_if(F.col("scope") == "all").alias("a"), F.count(F.lit(1)).alias("n")).filter("a > 0 and n > 1")
    if not both.isEmpty():
        raise ValueError("exclusions: scope all together with a narrower one")
    if subjects is not None:
        known_keys(df, subjects, ["subject_id", "dataset"], "exclusions")
    return df if scope is None else df.filter(F.col("scope").isin(scope, "all"))


def files_by_subject(spark: SparkSession, root: str, pattern: str, subject: str = r"([^/_]+)_[^/]*$") -> DataFrame:
    """subject, path of the files below root that match a glob; two files of one subject raise, as does a folder named otherwise."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern.rsplit("/", 1)[-1]).option("recursiveFileLookup", True).load(root).select("path")
    found = listed.select(F.regexp_extract("path", subject, 1).alias("subject"), "path")
    return unique_key(found, ["subject"], "files")


def keyed_values(spark: SparkSession, paths: DataFrame, keys: DataFrame, key: str, value: str, *, missing: str = "zero") -> DataFrame:
    """subject, key, value of one CSV a subject in a single scan. Unknown or repeated keys and values that are not finite raise; a missing key is 0 (zero) or raises (refuse)."""
    files = [r["path"] for r in paths.select("path").collect()]  # one short row a file, needed to name the scan
    schema = StructType([StructField(key, StringType()), StructField(value, DoubleType())])
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(files).withColumn("_p", F.col("_metadata.file_path"))
    rows = rows.join(paths.select(F.col("path").alias("_p"), "subject"), "_p").select("subject", key, value)
    if not rows.filter(F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).isEmpty():
        raise ValueError(f"{value}: not finite")
    unique_key(rows, ["subject", key], "values")
    known_keys(rows, keys, [key], "values")
    full = paths.select("subject").distinct().crossJoin(keys.select(key).distinct()).join(rows, ["subject", key], "left")  # the cells of the matrix
    if missing == "refuse" and not full.filter(F.col(value).isNull()).isEmpty():
        raise ValueError("values: a key is missing")
    return full.na.fill(0.0, [value])


def config_block(text: str) -> dict:
    """The fenced JSON object below '## Config' of a run's notes."""
    found = re.search(r"^## Config\s*```(?:json)?\s*(.*?)```", text, re.S | re.M)
    value = json.loads(found[1], object_pairs_hook=no_duplicates) if found else None
    if not isinstance(value, dict):
        raise ValueError("no JSON object under ## Config")
    return value


def params_line(text: str) -> dict:
    """The JSON object on the line that starts with 'Params used:'."""
    found = re.search(r"^\W*Params used:\W*(\{.*\})", text, re.M)
    value = json.loads(found[1]) if found else None
    if not isinstance(value, dict):
        raise ValueError("no JSON object after Params used:")
    return value


def no_duplicates(items: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in items}) < len(items):
        raise ValueError("a key is given twice")
    return dict(items)


def text_sections(text: str, expected: Sequence[str], bullets: Sequence[str] = ()) -> dict[str, str | tuple[str, ...]]:
    """Markdown sections '## kind: name': a paragraph, or its bullets for the kinds listed; the names must be the expected ones, each once and with text."""
    out: dict[str, str | tuple[str, ...]] = {}
    for head, body in re.findall(r"^## ([^\n]+)\n(.*?)(?=^## |\Z)", text, re.S | re.M):
        kind = head.split(":")[0].strip()
        lines = [x.strip() for x in body.strip().splitlines() if x.strip()]
        if head.strip() in out:
            raise ValueError(f"section given twice: {head.strip()}")
        if not lines:
            raise ValueError(f"empty section: {head.strip()}")
        out[head.strip()] = tuple(x.removeprefix("- ") for x in lines) if kind in bullets else " ".join(lines)
    if set(out) != set(expected):
        raise ValueError(f"sections differ: {sorted(set(out) ^ set(expected))}")
    return out
