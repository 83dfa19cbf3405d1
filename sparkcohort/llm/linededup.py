"""Line dedup by pairwise alignment.

Documents overlap where they share units: the shortest run of whole lines with `least_words` words or more that starts
or that ends at a line. A block of so many words is the union of its units, so whichever documents share a block share
units. Each unit's first holder is the earliest document with that unit; a later document is paired with the first
holders of its units, so a unit in a third of all documents makes one pair for each of them and none is too common to
count. A pair is aligned by patience diff: lines that are unique in both are anchors, the longest increasing run of
anchors is kept and grows over equal neighbours, and what is left is aligned again until no block comes off (so moved
passages count too); units that the pair shares beside its alignment count as well. Blocks of at least `least_words`
words are deleted from the later document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.shared import WORD, cut, forget, small_batches, tidied

#: Bytes of deletions that are broadcast at most; beyond that Spark joins by shuffle.
MOST_BROADCAST = 32_000_000
#: Rows of one or two numbers that are broadcast at most; beyond that Spark joins by shuffle and splits hot numbers.
MOST_ROWS = 1_000_000


def longest_run(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
        back[i] = at[pile - 1] if pile else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(first: list[int], later: list[int]) -> list[tuple[int, int]]:
    """Matched (position in first, position in later), in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(first), 0, len(later))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and first[a0] == later[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and first[a1 - 1] == later[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a: dict[int, int] = {}
        for i in range(a0, a1):
            once_a[first[i]] = -1 if first[i] in once_a else i
        once_b: dict[int, int] = {}
        for i in range(b0, b1):
            once_b[later[i]] = -1 if later[i] in once_b else i
        anchors = [(once_a[v], j) for v, j in once_b.items() if j >= 0 and once_a.get(v, -1) >= 0]
        if not anchors:  # only repeated lines are left: the first of one with the first of the other
            common = [(i, j) for v in once_b if v in once_a for i, j in [(first.index(v, a0, a1), later.index(v, b0, b1))]]
            if not common:
                continue
            anchors = [min(common, key=lambda x: (x[1], x[0]))]
        run = [anchors[k] for k in longest_run([i for i, _ in anchors])]
        ends = [(a0 - 1, b0 - 1), *run, (a1, b1)]
        out += run
        for (i, j), (k, m) in zip(ends[:-1], ends[1:], strict=True):
            if i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def units(lines: list[tuple[int, int, int]], least_words: int) -> list[tuple[int, int]]:
    """Index ranges [start, end) of the units among lines (line, hash, words) that follow each other by number."""
    out: set[tuple[int, int]] = set()
    begin = start = total = 0
    for end, (line, _, words) in enumerate(lines, 1):
        if end > 1 and line != lines[end - 2][0] + 1:
            begin, start, total = end - 1, end - 1, 0
        total += words
        while total >= least_words:
            out.add((start, end))
            total -= lines[start][2]
            start += 1
        if start > begin:
            out.add((start - 1, end))
    return sorted(out)


def common_blocks(first: list[tuple[int, int]], later: list[tuple[int, int, int]], least_words: int) -> list[int]:
    """Positions of the later document's lines in aligned blocks. first: (line, hash); later: (line, hash, words)."""
    gone: list[int] = []
    whole = later
    while later:
        pairs = patience([h for _, h in first], [h for _, h, _ in later])
        blocks: list[list[int]] = []
        for k, (i, j) in enumerate(pairs):
            if k and first[i][0] == first[pairs[k - 1][0]][0] + 1 and later[j][0] == later[pairs[k - 1][1]][0] + 1:
                blocks[-1].append(j)
            else:
                blocks.append([j])
        off = {j for b in blocks if sum(later[j][2] for j in b) >= least_words for j in b}
        if not off:
            break
        gone += [later[j][0] for j in off]
        later = [x for j, x in enumerate(later) if j not in off]
    words = {h: n for _, h, n in whole}
    known = [(i, h, words[h]) for i, h in first if h in words]
    has = {tuple(h for _, h, _ in known[a:b]) for a, b in units(known, least_words)}
    beside = {whole[j][0] for a, b in units(whole, least_words) if tuple(h for _, h, _ in whole[a:b]) in has for j in range(a, b)}
    return [*gone, *sorted(beside.difference(gone))]


def small(written: DataFrame) -> DataFrame:
    return F.broadcast(written) if written.count() <= MOST_ROWS else written


def line_deletions(docs: DataFrame, least_words: int) -> DataFrame:
    """row_key, flags: for documents with deletions, whether each \\n-split line goes. docs: row_key, place (order), text.

    `line` numbers the lines with a word, so that lines without one end no block; `at` is the place among all lines.
    """
    split = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("body")))
    lines = cut(
        small_batches(docs).select("row_key", "place", F.posexplode(F.filter(split, lambda x: x["body"].rlike(WORD))).alias("line", "x"))
        .select("row_key", "place", "line", "x.at", F.xxhash64("x.body").alias("hash"), F.regexp_count("x.body", F.lit(WORD)).alias("words"))
        .distinct(),
        "lines",
    )
    held = lines.groupBy("hash").agg(F.min(F.struct("place", "row_key")).alias("low"), F.max(F.struct("place", "row_key")).alias("high"))
    shared = cut(held.filter("low <> high").select(F.col("hash").alias("of_hash")), "lines-held")
    met = cut(lines.join(small(shared), F.col("hash") == F.col("of_hash")).select("row_key", "line", "hash", "words", "at", "place"), "lines-shared")
    by_doc = met.groupBy("row_key").agg(F.first("place").alias("place"), F.array_sort(F.collect_list(F.struct("line", "hash", "words", "at"))).alias("own"))
    by_doc = cut(by_doc.filter(F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["words"]) >= least_words), "lines-by-document")

    def unit_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            own = batch.column(2)
            columns, offsets = [c.to_numpy() for c in own.values.flatten()], own.offsets.to_numpy()
            for i in range(batch.num_rows):
                lines, codes, words, _ = (c[offsets[i] : offsets[i + 1]] for c in columns)
                found = {codes[a:b].tobytes() for a, b in units(list(zip(lines.tolist(), codes.tolist(), words.tolist(), strict=True)), least_words)}
                rows += [i] * len(found)
                hashes += [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in found]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes, pa.int64())], names=["row_key", "place", "unit"])

    held_units = cut(by_doc.select("row_key", "place", "own").mapInArrow(tidied(unit_hashes), "row_key long, place struct<last:boolean,id:long>, unit long"), "lines-units")
    firsts = held_units.groupBy("unit").agg(F.min(F.struct("place", "row_key")).alias("low"), F.max(F.struct("place", "row_key")).alias("high"))
    firsts = cut(firsts.filter("low <> high").select(F.col("unit").alias("of_unit"), F.col("low.row_key").alias("first")), "lines-firsts")
    pairs = held_units.join(small(firsts), F.col("unit") == F.col("of_unit")).filter("first <> row_key").select("first", "row_key").distinct()
    late = by_doc.select(F.col("row_key").alias("later_key"), "own")
    sides = pairs.join(late, F.col("row_key") == F.col("later_key")).select("first", "later_key", F.col("own").alias("later"))
    sides = sides.join(by_doc.select(F.col("row_key").alias("first_key"), F.transform("own", lambda x: F.struct(x["line"], x["hash"])).alias("early")), F.col("first") == F.col("first_key"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gone = [], []
            early, later = batch.column(1), batch.column(2)
            e, x = early.values.flatten(), later.values.flatten()
            e, x = [c.to_numpy() for c in e], [c.to_numpy() for c in x]
            eo, xo = early.offsets.to_numpy(), later.offsets.to_numpy()
            for i, key in enumerate(batch.column(0).to_pylist()):
                a = list(zip(*(c[eo[i] : eo[i + 1]].tolist() for c in e), strict=True))
                *b, at = (c[xo[i] : xo[i + 1]].tolist() for c in x)
                if off := common_blocks(a, list(zip(*b, strict=True)), least_words):
                    where = dict(zip(b[0], at, strict=True))
                    keys.append(key)
                    gone.append([where[line] for line in off])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["row_key", "gone"])

    found = sides.select("later_key", "early", "later").mapInArrow(tidied(align), "row_key long, gone array<int>")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for positions in batch.column(1).to_pylist():
                off = np.zeros(max(max(p) for p in positions) + 1, bool)
                for p in positions:
                    off[p] = True
                flags.append(off.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.list_(pa.bool_()))], names=["row_key", "flags"])

    out = cut(found.groupBy("row_key").agg(F.collect_list("gone").alias("gone")).mapInArrow(tidied(flag), "row_key long, flags array<boolean>"), "lines-deleted")
    forget(lines, shared, met, by_doc, held_units, firsts)
    return out


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """All columns of docs with text without the blocks that an earlier document has, and n_lines, n_removed, words_left.

    Earlier is the smaller doc_id (null last; of equal ids the smaller hash of the text). Rows alike in id and text
    are one document: they lose the same lines, and none to each other. A null text stays null, an empty one empty;
    lines without a word match nothing, end no block and stay; an empty table gives no rows. Columns of docs called n_lines,
    n_removed or words_left are replaced.
    """
    keyed = docs.withColumn("_dedup_key", F.xxhash64(doc_id, text))
    source = keyed.select(F.col("_dedup_key").alias("row_key"), F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).cast("long").alias("id")).alias("place"), F.col(text).alias("text")).filter(F.col("text") != "")
    gone = line_deletions(source, least_words).select(F.col("row_key").alias("_gone_key"), F.col("flags").alias("_gone_flags"))
    size = gone.agg(F.sum(24 + F.size("_gone_flags"))).first()[0] or 0
    gone = F.broadcast(gone) if size <= MOST_BROADCAST else gone.hint("shuffle_hash")
    joined = keyed.join(gone, F.col("_dedup_key") == F.col("_gone_key"), "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.get("_gone_flags", i), F.lit(False)))
    new = F.when(F.col("_gone_flags").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n_removed = F.coalesce(F.size(F.filter("_gone_flags", lambda f: f)), F.lit(0))
    n_removed = F.when(F.col("_gone_flags").isNull(), 0).otherwise(n_removed).cast("long")
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "words_left")]
    out = joined.select(*[F.col(c) if c != text else new.alias(text) for c in own], F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).cast("long").alias("n_lines"), n_removed.alias("n_removed"))
    return out.withColumn("words_left", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
