"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a word target. Its documents start with the same expected number of copies
(target / size of the source); whole copies are taken at once, and the fractional copy is settled by
pivotal rounding: two fractional documents exchange words, at random and without changing either
expectation, until one of them has a whole copy or none. Documents are rounded in small blocks of one
source; each block leaves at most one fractional document, and the residuals of 64 blocks meet in a block of
the next level, so a hot source only makes more blocks. Every exchange keeps the words of the source, so it
ends within one document of its target.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.llm.shared import WORD, cut

#: Below this a fraction counts as none.
TINY = 1e-12
#: Units (of about 100 bytes) that are broadcast at most; beyond that Spark joins by shuffle.
MOST_BROADCAST = 500_000
#: Rows alike in id, source and size that one task writes out at most.
MOST_ALIKE = 100_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of sources. sizes: source, source_size, n_units; one row a source, so one task ranks them all.

    Sources by code point, null last, weigh as given, repeating. They share `share` times all words; a target
    stops at `most` times its source's words, and what is over goes to the others by weight: sources in order of
    the level at which they are full, the full ones are a prefix.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    ranked = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.sum("cap").over(by_level) + F.col("cap")) / (F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight"))
    leveled = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return leveled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * final))).select("source", "sid", "source_size", "n_units", "target")


def _settle(acc: Column, x: Column) -> Column:
    """One pivotal step between the carried document and the next. acc: struct c (carried or null), out (settled)."""
    c = acc["c"]
    a, p, b, q = c["size"], c["f"], x["size"], x["f"]
    room_c, has_c, room_x, has_x = a * (1 - p), a * p, b * (1 - q), b * q
    up, down = F.least(room_c, has_x), F.least(has_c, room_x)
    gains = x["u"] * (up + down) < down
    whole = lambda v: F.when(v <= TINY, 0.0).when(v >= 1 - TINY, 1.0).otherwise(v)
    new_c = F.when(gains, F.when(room_c <= has_x, 1.0).otherwise(whole(p + has_x / a))).otherwise(F.when(has_c <= room_x, 0.0).otherwise(whole(p - room_x / a)))
    new_x = F.when(gains, F.when(has_x <= room_c, 0.0).otherwise(whole(q - room_c / b))).otherwise(F.when(room_x <= has_c, 1.0).otherwise(whole(q + has_c / b)))
    c2, x2 = c.withField("f", new_c), x.withField("f", new_x)
    c_done, x_done = new_c.isin(0.0, 1.0), new_x.isin(0.0, 1.0)
    nothing = F.lit(None)
    carried = F.when(c.isNull(), x).when(c_done & x_done, nothing).when(c_done, x2).otherwise(c2)
    out = F.when(c.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.when(c_done & x_done, F.array(c2, x2)).when(c_done, F.array(c2)).otherwise(F.array(x2))))
    return F.struct(carried.alias("c"), out.alias("out"))


def settled_units(docs: DataFrame, doc_id: str, text: str, source: str, weights: Sequence[float], share: float, most: float, block: int, seed: int) -> DataFrame:
    """One row for all rows alike in doc_id, source and size: their number k, the whole copies of each, how many have one more (extra), and whether the next has (f = 1)."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    units = cut(base.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("k")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("k")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    sources = cut(source_targets(sizes, weights, share, most).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n_units") / block))), "mix-sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mass = F.col("k") * (F.col("ratio") - F.floor("ratio"))
    items = (
        units.join(sources.withColumnRenamed("source", "source_name"), F.col("source").eqNullSafe(F.col("source_name")))
        .withColumn("ratio", ratio)
        .withColumn("whole", F.floor("ratio"))
        .withColumn("extra", F.floor(mass + TINY))
        .withColumn("f", F.when((F.col("size") > 0) & (mass - F.col("extra") > TINY), mass - F.col("extra")).otherwise(0.0))
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size"))
        .withColumn("block", F.pmod("h", "n_blocks"))
        .select("doc_id", "source", "source_size", "target", "size", "k", "whole", "extra", "f", "h", "sid", "block")
    )
    blocks = sources.agg(F.max("n_blocks")).first()[0] or 1
    levels = 1 + max(0, math.ceil(math.log(blocks) / math.log(block) - 1e-9))
    fractional = (F.col("f") > 0) & (F.col("f") < 1)
    settled, pending = [items.filter(~fractional)], items.filter(fractional)
    carry = [c for c in items.columns if c not in ("sid", "block", "h")]
    for level in range(levels):
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1 + level), "h"), 11) * F.lit(2.0**-53)
        item = F.struct("h", *carry, u.alias("u"))
        grouped = pending.groupBy("sid", "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
        kind = grouped.schema["items"].dataType.elementType.simpleString()
        start = F.struct(F.lit(None).cast(kind).alias("c"), F.array().cast(f"array<{kind}>").alias("out"))
        done = grouped.withColumn("state", F.aggregate("items", start, _settle))
        rows = done.select("sid", F.floor(F.col("block") / block).alias("block"), F.explode(F.when(F.col("state.c").isNull(), F.col("state.out")).otherwise(F.concat("state.out", F.array("state.c")))).alias("x"))
        rows = rows.select("sid", "block", "x.*")
        if level == levels - 1:  # one fractional document of a source is left
            draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h", F.lit("last")), 11) * F.lit(2.0**-53)
            rows = rows.withColumn("f", F.when(fractional, (draw < F.col("f")).cast("double")).otherwise(F.col("f")))
        rows = cut(rows.drop("u"), f"mix-level{level}")
        settled.append(rows.filter(~fractional).select(*items.columns))
        pending = rows.filter(fractional).select(*items.columns)
    all_rows = settled[0]
    for more in settled[1:]:
        all_rows = all_rows.unionByName(more)
    return all_rows


def copies_of(i: Column, unit: str = "") -> Column:
    """Copies of the i-th (from 1) of a unit's rows. unit: what stands before the unit's column names."""
    size, whole, extra, f = (F.col(unit + c) for c in ("size", "whole", "extra", "f"))
    more = (i <= extra).cast("long") + ((i == extra + 1) & (f == 1)).cast("long")
    return (whole + F.when(size > 0, more).otherwise(0)).cast("long")


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, seed: int = 17) -> DataFrame:
    """Copies of each document so that the sources' words come near their targets.

    Returns one row per input row: doc_id, size, source, source_size, target, copies, taken. A null text has
    size 0 and is never copied; a null source is a source of its own, ranked last; an empty table gives no rows.
    Rows alike in doc_id, source and size are one unit with a count: they share whole copies and only the rest
    is rounded, so any number of repeated rows (or null ids) stays one row until the end. Other columns are not
    read. Draws come from hashes of doc_id, source and size, so reruns agree.
    """
    units = settled_units(docs, doc_id, text, source, weights, share, most, block, seed)
    if (units.agg(F.max("k")).first()[0] or 0) > MOST_ALIKE:  # rows alike by the million are dealt out before they are written one by one
        units = units.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(k - 1) div {MOST_ALIKE}")))).repartition("doc_id", "source", "size", "part")
        numbers = F.sequence(F.col("part") * MOST_ALIKE + 1, F.least("k", (F.col("part") + 1) * MOST_ALIKE))
    else:
        numbers = F.sequence(F.lit(1).cast("long"), F.col("k"))
    out = units.withColumn("i", F.explode(numbers)).withColumn("copies", copies_of(F.col("i")))
    return out.select("doc_id", "size", "source", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources() takes it, with the columns of docs."""
    units = cut(settled_units(docs, doc_id, text, source, weights, share, most, block, seed), "mix-settled")
    sized = docs.withColumn("_size", word_count(F.col(text)))
    same = [F.col(doc_id).eqNullSafe(F.col("_u.doc_id")), F.col(source).eqNullSafe(F.col("_u.source")), F.col("_size") == F.col("_u.size")]
    stats = units.agg(F.count(F.lit(1)), F.max("k")).first()
    packed = units.select(F.struct("doc_id", "source", "size", "whole", "extra", "f").alias("_u"))
    joined = sized.join(F.broadcast(packed) if stats[0] <= MOST_BROADCAST else packed, same)
    order = Window.partitionBy(doc_id, source, "_size").orderBy(F.xxhash64(text))
    joined = joined.withColumn("_i", F.row_number().over(order) if (stats[1] or 0) > 1 else F.lit(1))
    copies = copies_of(F.col("_i"), "_u.").cast("int")
    return joined.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
