"""Assertions on frames. Each runs one small aggregate and raises ValueError with examples."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 5


def _refuse(bad: DataFrame, what: str) -> None:
    rows = bad.limit(SHOWN).collect()
    if rows:
        raise ValueError(f"{what}: {', '.join(str(tuple(r)) for r in rows)}")


def unique_key(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    _refuse(df.groupBy(*keys).count().filter("count > 1").select(*keys), f"{what}: duplicate key")
    return df


def required_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what}: missing columns {absent}")
    return df


def known_keys(df: DataFrame, known: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    """Every key of df is in known."""
    _refuse(df.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti"), f"{what}: unknown key")
    return df


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], what: str = "tables") -> None:
    known_keys(a, b, keys, f"{what}: only in the first")
    known_keys(b, a, keys, f"{what}: only in the second")


def closed_vocabulary(df: DataFrame, column: str, words: Iterable[str], what: str | None = None) -> DataFrame:
    _refuse(df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*words)).select(column).distinct(), what or f"{column}: not in its vocabulary")
    return df


def strict_boolean(column: Column) -> Column:
    """True or False as text to boolean; anything else raises when it is read."""
    return F.when(column == "True", True).when(column == "False", False).otherwise(F.raise_error(F.concat(F.lit("not True or False: "), F.coalesce(column, F.lit("null")))).cast("boolean"))


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def finite_numeric(df: DataFrame, key: str, column: str, what: str | None = None) -> DataFrame:
    """column as double; text that is no number, null, NaN and infinity raise."""
    value = F.col(column).try_cast("double")
    _refuse(df.filter(~is_finite(value)).select(key, column), what or f"{column}: not a finite number")
    return df.withColumn(column, value)


def binary_values(df: DataFrame, column: str, what: str | None = None) -> DataFrame:
    _refuse(df.filter(F.col(column).isNull() | ~F.col(column).isin(0, 1)).select(column), what or f"{column}: not 0 or 1")
    return df


def values_in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    _refuse(df.filter(~F.col(column).between(low, high)).select(column), f"{column}: outside [{low}, {high}]")
    return df


def one_value(df: DataFrame, column: str, what: str = "rows") -> object:
    """The only distinct value of a column."""
    found = df.select(column).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{what}: expected one value of {column}")
    return found[0][0]
