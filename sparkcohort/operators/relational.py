"""Admission, enrichment and upserts: joins in which no row goes missing silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.operators.checks import same_keys, unique_key


def admit(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]], excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, audit of key and reason). Rules are (reason, condition to keep) in order; a row counts at its first failure, and only then against the exclusion list."""
    reason = F.lit(None).cast("string")
    for name, keep in reversed(rules):
        reason = F.when(~F.coalesce(keep, F.lit(False)), name).otherwise(reason)
    judged = rows.withColumn("_reason", reason)
    if excluded is not None:
        listed = excluded.select(F.col(key).alias("_listed")).distinct()
        judged = judged.join(listed, F.col(key) == F.col("_listed"), "left").withColumn("_reason", F.coalesce("_reason", F.when(F.col("_listed").isNotNull(), "excluded by list"))).drop("_listed")
    return judged.filter("_reason is null").drop("_reason"), judged.filter("_reason is not null").select(key, F.col("_reason").alias("reason"))


def presence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, in_a, in_b over both key sets."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return left.join(right, key, "full_outer").select(key, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def align(a: DataFrame, b: DataFrame, key: str, column: str, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Inner join of one column of two frames on a key that is unique in both."""
    unique_key(a, [key], "first")
    unique_key(b, [key], "second")
    return a.select(key, F.col(column).alias(names[0])).join(b.select(key, F.col(column).alias(names[1])), key)


def fill_gaps(rows: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, column: str) -> DataFrame:
    """rows with column filled from the first source that has a value, and <column>_source naming it (registry: it had one)."""
    value, origin = F.col(column), F.when(F.col(column).isNotNull(), "registry")
    for i, (name, source) in enumerate(sources):
        rows = rows.join(unique_key(source, [key], name).select(F.col(key).alias(f"_k{i}"), F.col(column).alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
        origin = F.coalesce(origin, F.when(F.col(f"_v{i}").isNotNull(), name))
        value = F.coalesce(value, F.col(f"_v{i}"))
    drop = [f"_{x}{i}" for i in range(len(sources)) for x in "kv"]
    return rows.withColumns({column: value, f"{column}_source": origin}).drop(*drop)


def write_column(rows: DataFrame, fresh: DataFrame, key: str, column: str, *, in_scope: Column, protected: Column, overwrite: bool) -> DataFrame:
    """rows with the column written by rule, and _conflict. Out of scope or protected: kept. Append fills nulls and marks differing values; overwrite replaces where fresh has a value."""
    joined = rows.join(unique_key(fresh, [key], "fresh").select(F.col(key).alias("_k"), F.col(column).alias("_v")), F.col(key) == F.col("_k"), "left")
    free = in_scope & ~protected
    old, new = F.col(column), F.col("_v")
    value = F.when(~free, old).otherwise(F.coalesce(new, old) if overwrite else F.coalesce(old, new))
    conflict = F.lit(False) if overwrite else F.coalesce(free & (old != new), F.lit(False))
    return joined.withColumns({"_conflict": conflict, column: value}).drop("_k", "_v")


def upsert(existing: DataFrame, fresh: DataFrame, key: str, *, overwrite: bool) -> DataFrame:
    """append: existing and the fresh rows whose key is new. overwrite: fresh rows with the columns that only existing has, looked up, and existing rows that fresh lacks."""
    if not overwrite:
        return existing.unionByName(fresh.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)
    foreign = [c for c in existing.columns if c not in fresh.columns]
    renewed = fresh.join(existing.select(key, *foreign), key, "left")
    return renewed.unionByName(existing.join(fresh.select(key), key, "left_anti"), allowMissingColumns=True).select(*existing.columns)


def conflicts(existing: DataFrame, new: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys in both with differing values: keys, old, new."""
    e = existing.select(*keys, F.col(column).alias("old"))
    return e.join(new.select(*keys, F.col(column).alias("new")), list(keys)).filter(~F.col("old").eqNullSafe(F.col("new")))


def merge_columns(results: DataFrame, table: DataFrame, keys: Sequence[str], owned: Sequence[str]) -> DataFrame:
    """results with the owned columns replaced from table; the keys must be the same set in both."""
    same_keys(results, table, keys, "merge")
    return results.drop(*owned).join(unique_key(table, keys).select(*keys, *owned), list(keys), "left")


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and change: added, removed or changed."""
    others = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*others).alias("_o"))
    n = new.select(*keys, F.struct(*others).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return o.join(n, list(keys), "full_outer").select(*keys, kind.alias("change")).filter("change is not null")


def in_every_group(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys found in all groups: one aggregate instead of a chain of intersections."""
    n = df.select(group).distinct().count()
    return df.groupBy(key).agg(F.countDistinct(group).alias("_n")).filter(F.col("_n") == n).select(key)


def split_sample(ids: DataFrame, key: str, n: int, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(the n first ids in order and those to keep, the rest)."""
    first = ids.select(key).distinct().orderBy(key).limit(n)
    chosen = first.union(ids.select(key).filter(F.col(key).isin(*keep))).distinct()
    return chosen, ids.select(key).distinct().join(chosen, key, "left_anti")


def lookup(rows: DataFrame, table: DataFrame, key: str, column: str, *, numeric: bool = False, unknown: str = "unknown") -> DataFrame:
    """rows with column from table: a missing row and an empty cell are alike, null for numbers and `unknown` for words."""
    found = unique_key(table, [key], column).select(F.col(key).alias("_k"), F.col(column).cast("string").alias("_v"))
    blank = F.col("_v").isNull() | (F.trim("_v") == "")
    value = F.when(~blank, F.col("_v").try_cast("double")) if numeric else F.when(blank, unknown).otherwise(F.col("_v"))
    return rows.drop(column).join(found, F.col(key) == F.col("_k"), "left").withColumn(column, value).drop("_k", "_v")
