"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tests_support import TABLES

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    want = duck.sql(ORACLES[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert os.path.exists(DIR)


def test_mixture_reads_whole_embeddings(spark):
    from pyspark.sql import functions as F

    from sparkcohort.operators.cluster import gaussian_mixture

    e = spark.read.parquet(f"{DIR}/embeddings.parquet")
    fitted = lambda x: {r.vec_id: r.label for r in gaussian_mixture(e.select("vec_id", x.alias("x")), "vec_id", "x", 3)[0].collect()}
    got = {r.vec_id: r.label for r in entry.queries()["gmm"](spark, DIR).collect()}
    assert got == fitted(F.col("embedding")) != fitted(F.slice("embedding", 1, 4))


def test_rounding_is_that_of_the_oracles(spark, tmp_path):
    values = [-0.000001, 0.000001, -0.0, 0.0, 2.5, -2.5, 1.000005, -1.000005, 0.285, 1e300, -7.123455, float("inf"), float("nan"), None]
    spark.createDataFrame([(1, values, 0)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ORACLES["stacked_vectors"]).fetchall()[0][1]
    assert repr(QUERIES["stacked_vectors"](spark, str(tmp_path)).first()["x"]) == repr(want)
