"""Sinks and artifacts: a folder of Parquet tables that counts once its manifest is there, and an append-only run log."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, run_type string, time timestamp, params string, output string, notes string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def save(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], config: Mapping, *, overwrite: bool = False, validate: Callable[[str], object] | None = None) -> str:
    """Write all tables and the config beside the target, check them, then rename: a reader sees all of it or nothing.

    An old artifact is set aside first and deleted last; if the new one cannot take its place, it comes back.
    """
    if exists(spark, folder) and not overwrite:
        raise ValueError(f"{folder} exists")
    staged = folder.rstrip("/") + ".staged"
    fs, p = _fs(spark, staged)
    fs.delete(p, True)
    for name, df in tables.items():
        df.write.parquet(f"{staged}/{name}")
    spark.createDataFrame([(json.dumps(dict(config), sort_keys=True),)], "value string").coalesce(1).write.text(f"{staged}/manifest")
    if validate:
        validate(staged)
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    aside = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + ".old")
    replaces = exists(spark, folder)
    if replaces:
        fs.delete(aside, True)
        if not fs.rename(target, aside):
            raise OSError(f"{folder} could not be set aside")
    if not fs.rename(p, target):
        if replaces:
            fs.rename(aside, target)
        raise OSError(f"{staged} could not be renamed")
    if replaces:
        fs.delete(aside, True)
    return folder


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if not exists(spark, f"{folder}/manifest/_SUCCESS"):
        raise ValueError(f"{folder} has no manifest")
    return spark.read.parquet(f"{folder}/{name}")


def config(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest").first()[0])


def append_log(spark: SparkSession, folder: str, run_id: str, run_type: str, params: Mapping, output: str, notes: str = "") -> None:
    """One row more in the log, partitioned by run_type; a log with other columns raises."""
    row = spark.createDataFrame([(run_id, run_type, json.dumps(dict(params), sort_keys=True), output, notes)], "run_id string, run_type string, params string, output string, notes string").withColumn("time", F.current_timestamp())
    if exists(spark, folder) and set(spark.read.parquet(folder).columns) != set(row.columns):
        raise ValueError("the log has other columns")
    row.coalesce(1).write.mode("append").partitionBy("run_type").parquet(folder)


def write_combinations(df: DataFrame, folder: str, outer: list[str]) -> None:
    """One k=v folder for each combination of the outer parameters."""
    df.write.partitionBy(*outer).parquet(folder)
