"""Jaccard join of documents on word shingles, with exact prefix filters under several global token orders.

Two sets of a and b tokens that link share at least ceil(share * (a + b) / (100 + share)) of them, so under any global
order of tokens each has a common token among its first n - ceil(share * n / 100) + 1 (its prefix). A pair has to pass
the filters of three orders before its sets are compared; no filter is lossy.

1. Every text becomes a class by its shingle set; copies share a class. First order, over all classes: tokens that one
   class only has come first. A class whose whole prefix is of such tokens links with nothing. To find them, each chunk
   of a partition sends every distinct token once, with its class or a mark that several classes of the chunk have
   it, as packed blocks to buckets of the token's value; buckets send back how many tokens each class shares. So a token
   that a third of all texts have makes one entry for a chunk.
2. Second order, over the classes left: rarest token first. Chunks send distinct tokens with local counts and get counts
   over all chunks back; each class then goes to the buckets of its prefix tokens.
3. A bucket is not expanded into its pairs. First its leader (the class with the largest share of tokens that others
   have, so an original rather than an edited copy) meets the others, and links are joined into components. Then
   members of different components meet, where the places of the bucket's token in both orders leave room for a link:
   at the first token that two linked sets share, min(n - place) of both is at least what they must share, and the
   smaller set's place lies in the first (100 - share) / (100 + share) or so of it. Families of near copies are in one
   component by then, so next to no pairs are left.
4. Pairs must also share a token of their prefixes under the third order, by token number. Only then do whole sets move
   to the pair, and their intersection decides.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.llm.components import components
from sparkcohort.llm.shared import cut, forget, small_batches, tidied
from sparkcohort.llm.shingles import shingle_sets

#: Rows whose ids are broadcast at most, at 16 bytes each; beyond that Spark joins by shuffle.
MOST_BROADCAST = 2_000_000
#: Buckets at most, so that the blocks of a chunk do not shrink to single tokens; a larger bucket is worked on in slices.
MOST_BUCKETS = 1 << 17

_DOC = "doc_id long, row_key long, n long, class_id long, here long"
_LONG = pa.list_(pa.int64())


def class_number(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _longs(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of uint32, byte by byte of each, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def unpack(data: bytes, size: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=4 * size * columns, codec="zstd"), np.uint8).reshape(columns, 4, size)
    return [np.ascontiguousarray(c.T).view("<u4").ravel() for c in raw]


def coarse(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (from the upper half of a token) and lower half, as one uint64. Tokens that agree in both count as one; that refuses no link."""
    raw = tokens.view(np.uint64)
    return ((raw >> np.uint64(32)) * np.uint64(buckets) & np.uint64(0xFFFFFFFF00000000)) | (raw & np.uint64(0xFFFFFFFF))


def blocks(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of a bucket in sorted coarse tokens."""
    tops = (sorted_values >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(tops, prepend=-1, append=-1))
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(tops[start]), start, end


def deltas(sorted_low: np.ndarray) -> np.ndarray:
    return np.diff(sorted_low, prepend=np.uint32(0))


def _chunks(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[list[list], list[np.ndarray]]]:
    """The columns but the last (as lists) and the shingle sets of the last, for up to about `most` tokens at a time."""
    rows: list[list] = []
    sets: list[np.ndarray] = []
    held = 0
    for whole in batches:
        rows = rows or [[] for _ in range(whole.num_columns - 1)]
        for at in range(0, whole.num_rows, 256):  # sets are larger than texts
            batch = whole.slice(at, 256)
            for got, column in zip(rows, batch.columns, strict=False):
                got += column.to_pylist()
            for s in shingle_sets([x or b"" for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()], width):
                sets.append(s)
                held += len(s)
            if held >= most:
                yield rows, sets
                rows, sets, held = [[] for _ in rows], [], 0
    if sets:
        yield rows, sets


def _rows(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    """A batch with nulls in the columns that are not given."""
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * rows), f.type) for f in schema], schema=schema)


_SENT = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("class_id", pa.int64()), ("here", pa.int64()), ("size", pa.int64()), ("classes", pa.binary()), ("block", pa.binary())])
_BACK = pa.schema([(f.name, f.type) for f in _SENT if f.name not in ("size", "block")] + [("shared", pa.binary())])


def sent(docs: DataFrame, width: int, buckets: int, chunk_tokens: int) -> DataFrame:
    """Rows of documents (doc_id, row_key, n, class_id, here: tokens that other classes of the chunk have) and packed blocks of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, keys), sets in _chunks(batches, width, chunk_tokens):
            numbers = [class_number(s) for s in sets]
            first = {c: i for i, c in reversed(list(enumerate(numbers)))}  # one of the copies in the chunk
            of, kept = np.array(list(first), np.int64), [sets[i] for i in first.values()]
            sizes = [len(s) for s in kept]
            values = coarse(np.concatenate(kept), buckets)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(of)), sizes)[order]
            del order
            new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
            several = np.concatenate([~new[1:], [False]]) if len(values) else new
            here = np.bincount(owner[several | ~new], minlength=len(of))
            values, owner, several = values[new], owner[new], several[new]
            by_class = dict(zip(first, here.tolist(), strict=True))
            n = len(sets)
            yield _rows(_SENT, n, bucket=pa.array([k % buckets for k in keys], pa.int64()), doc_id=pa.array(ids, pa.int64()), row_key=pa.array(keys, pa.int64()), n=pa.array([len(s) for s in sets], pa.int64()), class_id=pa.array(numbers, pa.int64()), here=pa.array([by_class[c] for c in numbers], pa.int64()))
            out: list[list] = [[], [], [], []]
            for bucket, start, end in blocks(values):
                named, index = np.unique(owner[start:end][~several[start:end]], return_inverse=True)
                column = np.full(end - start, len(named))
                column[~several[start:end]] = index
                low = (values[start:end] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for got, x in zip(out, (bucket, end - start, of[named].tobytes(), pack(deltas(low), column)), strict=True):
                    got.append(x)
                if len(out[0]) >= 4096:
                    yield _rows(_SENT, len(out[0]), **dict(zip(("bucket", "size", "classes", "block"), out, strict=True)))
                    out = [[], [], [], []]
            if out[0]:
                yield _rows(_SENT, len(out[0]), **dict(zip(("bucket", "size", "classes", "block"), out, strict=True)))

    return docs.mapInArrow(tidied(run), f"bucket long, {_DOC}, size long, classes binary, block binary")


def _slices(lows: list[np.ndarray], most: int) -> Iterator[list[tuple[int, int]]]:
    """For each slice of the values, the ranges of the sorted arrays in it; a slice has about `most` tokens."""
    parts = max(1, -(-sum(map(len, lows)) // most))
    edges = [np.searchsorted(x, np.linspace(0, 1 << 32, parts + 1)[1:-1].astype(np.uint64)) for x in lows]
    ends = [np.concatenate([[0], e, [len(x)]]).astype(int) for e, x in zip(edges, lows, strict=True)]
    for i in range(parts):
        yield [(int(e[i]), int(e[i + 1])) for e in ends]


def sent_back(table: pa.Table, buckets: int, slice_tokens: int) -> pa.Table:
    """The document rows of a bucket, and how many of the tokens sent with a class some other class has, packed for the buckets of classes."""
    is_doc = table["n"].is_valid()
    docs, rest = table.filter(is_doc).select(["doc_id", "row_key", "n", "class_id", "here"]), table.filter(pa.compute.invert(is_doc))
    lows, owners, names = [], [], []
    for size, classes, block in zip(*(rest[c].to_pylist() for c in ("size", "classes", "block")), strict=True):
        low, owner = unpack(block, size, 2)
        lows.append(np.cumsum(low, dtype=np.uint32))
        owners.append(owner)
        names.append(np.append(np.frombuffer(classes, np.int64), 0))
    counts: dict[int, int] = {}
    for ranges in _slices(lows, slice_tokens):
        low = np.concatenate([x[a:b] for x, (a, b) in zip(lows, ranges, strict=True)] or [np.empty(0, np.uint32)])
        if not len(low):
            continue
        several = np.concatenate([o[a:b] == len(n) - 1 for o, n, (a, b) in zip(owners, names, ranges, strict=True)])
        of = np.concatenate([n[o[a:b]] for o, n, (a, b) in zip(owners, names, ranges, strict=True)])
        order = np.lexsort((of, low))
        low, several, of = low[order], several[order], of[order]
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        shared = np.logical_or.reduceat(several, start) | (np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start))
        again = np.concatenate([[False], (low[1:] == low[:-1]) & (of[1:] == of[:-1])])  # copies of one class in two chunks
        which, many = np.unique(of[np.repeat(shared, np.diff(start, append=len(low))) & ~several & ~again], return_counts=True)
        for c, m in zip(which.tolist(), many.tolist(), strict=True):
            counts[c] = counts.get(c, 0) + m
    of, many = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    to = of % buckets
    order = np.argsort(to, kind="stable")
    of, many, to = of[order], many[order], to[order]
    edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
    ranges = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    back = _rows(_BACK, len(ranges), bucket=[int(to[a]) for a, _ in ranges], classes=[of[a:b].tobytes() for a, b in ranges], shared=[many[a:b].tobytes() for a, b in ranges])
    whole = [docs[f.name].cast(f.type) if f.name in docs.column_names else pa.nulls(docs.num_rows, f.type) for f in _BACK]
    return pa.concat_tables([pa.table(whole, schema=_BACK), pa.Table.from_batches([back])])


def sums(table: pa.Table) -> pa.Table:
    """class_id, shared of a bucket of classes."""
    read = lambda c: np.concatenate([np.frombuffer(x, np.int64) for x in table[c].to_pylist()])
    of, index = np.unique(read("classes"), return_inverse=True)
    return pa.table([pa.array(of), pa.array(np.bincount(index, weights=read("shared")).astype(np.int64))], names=["class_id", "shared"])


_SET = pa.schema([("chunk", pa.string()), ("class_id", pa.int64()), ("n", pa.int64()), ("tokens", _LONG), ("bucket", pa.int64()), ("size", pa.int64()), ("block", pa.binary())])


def class_sets(docs: DataFrame, wanted: DataFrame, width: int, buckets: int, chunk_tokens: int) -> DataFrame:
    """Sets of the wanted (row_key, class_id, n) rows by chunk, and packed blocks of the distinct tokens of each chunk with local counts.

    Their texts are read again, which costs less than keeping all sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), sets in _chunks(batches, width, chunk_tokens):
            mine = {c: s for c, s in zip(ids, sets, strict=True) if class_number(s) == c}  # not rows of an equal key by chance
            if not mine:
                continue
            chunk, kept = uuid.uuid4().hex, list(mine.values())
            for at in range(0, len(kept), 512):
                part = kept[at : at + 512]
                yield _rows(_SET, len(part), chunk=[chunk] * len(part), class_id=pa.array(list(mine)[at : at + 512], pa.int64()), n=pa.array([len(s) for s in part], pa.int64()), tokens=_longs(part))
            values, count = np.unique(coarse(np.concatenate(kept), buckets), return_counts=True)
            out: list[list] = [[], [], []]
            for bucket, start, end in blocks(values):
                low = (values[start:end] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for got, x in zip(out, (bucket, end - start, pack(deltas(low), count[start:end])), strict=True):
                    got.append(x)
            yield _rows(_SET, len(out[0]), chunk=[chunk] * len(out[0]), bucket=out[0], size=out[1], block=out[2])

    keys = wanted.select(F.col("row_key").alias("wanted_key"), "class_id")
    rows = docs.join(small(keys, wanted.count()), F.col("row_key") == F.col("wanted_key"))
    return rows.select("class_id", "text").mapInArrow(tidied(run), "chunk string, class_id long, n long, tokens array<long>, bucket long, size long, block binary")


def counts_back(table: pa.Table, slice_tokens: int) -> pa.Table:
    """For each chunk of a bucket, its tokens that more than one class has, with the number of classes."""
    lows, counts = [], []
    for size, block in zip(table["size"].to_pylist(), table["block"].to_pylist(), strict=True):
        low, count = unpack(block, size, 2)
        lows.append(np.cumsum(low, dtype=np.uint32))
        counts.append(count.astype(np.int64))
    found: list[list[np.ndarray]] = [[] for _ in lows]
    totals: list[list[np.ndarray]] = [[] for _ in lows]
    for ranges in _slices(lows, slice_tokens):
        parts = [x[a:b] for x, (a, b) in zip(lows, ranges, strict=True)]
        values, index = np.unique(np.concatenate(parts), return_inverse=True)
        many = np.bincount(index, weights=np.concatenate([c[a:b] for c, (a, b) in zip(counts, ranges, strict=True)]), minlength=len(values)).astype(np.int64)
        for i, part in enumerate(parts):
            own = many[np.searchsorted(values, part)] if len(part) else np.empty(0, np.int64)
            found[i].append(part[own > 1])
            totals[i].append(np.minimum(own[own > 1], 0xFFFFFFFF))
    out = [(c, b, sum(map(len, f)), pack(deltas(np.concatenate(f)), np.concatenate(t))) for c, b, f, t in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), found, totals, strict=True) if any(map(len, f))]
    return pa.table([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())], names=["chunk", "bucket", "size", "block"])


_MEMBER = "token long, class_id long, n long, place long, alone double"


def members_of(sets: DataFrame, share: int, buckets: int, slice_tokens: int) -> DataFrame:
    """token, class_id, n, place (under the second order), alone (share of tokens that no other class has): the prefixes of the classes."""

    def prefixes(rows: pa.Table, told: pa.Table) -> pa.Table:
        values, many = [], []
        for bucket, size, block in sorted(zip(*(told[c].to_pylist() for c in ("bucket", "size", "block")), strict=True), key=lambda x: x[0]):
            low, count = unpack(block, size, 2)
            values.append(np.cumsum(low, dtype=np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            many.append(count)
        values, many = np.concatenate(values or [np.empty(0, np.uint64)]), np.concatenate(many or [np.empty(0, np.uint32)])
        lists = rows["tokens"].combine_chunks()
        tokens, n = lists.flatten().to_numpy(), rows["n"].to_numpy()
        own = np.repeat(np.arange(len(n)), n)
        mine = coarse(tokens, buckets)
        at = np.minimum(np.searchsorted(values, mine), max(0, len(values) - 1))
        df = np.where(values[at] == mine, many[at], 1) if len(values) else np.ones(len(mine), int)
        order = np.lexsort((tokens, df, own))
        place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        tokens, own, df = tokens[order], own[order], df[order]
        alone = np.bincount(own[df == 1], minlength=len(n)) / np.maximum(n, 1)
        take = (df > 1) & (place < (n + (-share * n // 100) + 1)[own])
        of = own[take]
        return pa.table([pa.array(tokens[take]), pa.array(rows["class_id"].to_numpy()[of]), pa.array(n[of]), pa.array(place[take]), pa.array(alone[of])], names=["token", "class_id", "n", "place", "alone"])

    told = sets.filter("bucket is not null").select("chunk", "bucket", "size", "block").groupBy("bucket").applyInArrow(lambda t: counts_back(t, slice_tokens), "chunk string, bucket long, size long, block binary")
    rows = sets.filter("n is not null").select("chunk", "class_id", "n", "tokens")
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(prefixes, _MEMBER)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast where its number of rows allows it; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def least_common(both: Column, share: int) -> Column:
    """What two linked sets of that many tokens together share at least."""
    return F.ceil(both * share / (100 + share))


def linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """Whether 100 * intersection >= share * union."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= share * (len(a) + len(b) - common)


def links_among(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """a, b of the pairs (a, b) that pass the third order's filter and link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
                sides.append([values[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)])
            found = pa.array([linked(x, y, share) for x, y in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(found), batch.column(1).filter(found)], names=["a", "b"])

    def with_sides(pairs: DataFrame, column: Column, name: str) -> DataFrame:
        few = pairs.count()
        sides = (sets.select(F.col("class_id").alias(f"{s}_id"), column.alias(f"{s}_{name}")).join(small(pairs, few), F.col(s) == F.col(f"{s}_id")).select("a", "b", f"{s}_{name}") for s in "ab")
        left, right = sides
        return left.join(right, ["a", "b"])

    by_number = F.slice("tokens", 1, (F.col("n") - F.ceil(F.col("n") * share / 100) + 1).cast("int"))
    met = cut(with_sides(pairs, by_number, "prefix").filter(F.arrays_overlap("a_prefix", "b_prefix")).select("a", "b"), "ngram-met")
    links = cut(with_sides(met, F.col("tokens"), "tokens").select("a", "b", "a_tokens", "b_tokens").mapInArrow(tidied(run), "a long, b long"), "ngram-links")
    forget(met)
    return links


def component_labels(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """node, label of the classes that links join."""
    pair = [F.least("class_id", "leader").alias("a"), F.greatest("class_id", "leader").alias("b")]
    leads = members.groupBy("token").agg(F.min(F.struct("alone", "class_id", "n")).alias("x"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    leads = leads.select(F.col("token").alias("of"), F.col("x.class_id").alias("leader"), F.col("x.n").alias("lead_n"))
    fits = F.least("n", "lead_n") >= least_common(F.col("n") + F.col("lead_n"), share)
    first = cut(members.join(leads, (F.col("token") == F.col("of")) & (F.col("class_id") != F.col("leader")) & fits).select(*pair).distinct(), "ngram-pairs")
    links = links_among(first, sets, share)
    labels = cut(components(links), "ngram-labels")
    now = members.join(small(labels, 2 * links.count()), F.col("class_id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "class_id"))
    spans = now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select(F.col("token").alias("of"))
    active = cut(now.join(spans, F.col("token") == F.col("of")).select("token", "class_id", "n", "place", "label"), "ngram-active")
    lesser = active.filter(F.col("n") - F.col("place") >= least_common(2 * F.col("n"), share))  # of the smaller of two
    lesser = lesser.select(F.col("token").alias("of"), F.col("class_id").alias("leader"), F.col("n").alias("lead_n"), F.col("place").alias("lead_place"), F.col("label").alias("lead_label"))
    meet = (F.col("token") == F.col("of")) & (F.col("label") != F.col("lead_label")) & (F.col("lead_n") <= F.col("n"))
    room = F.least(F.col("n") - F.col("place"), F.col("lead_n") - F.col("lead_place")) >= least_common(F.col("n") + F.col("lead_n"), share)
    second = active.join(lesser, meet & room).select(*pair).distinct()
    old = first.select(F.col("a").alias("old_a"), F.col("b").alias("old_b"))
    second = cut(second.join(old, (F.col("a") == F.col("old_a")) & (F.col("b") == F.col("old_b")), "left_anti"), "ngram-pairs")
    more = links_among(second, sets, share)
    if not more.isEmpty():
        all_links = cut(links.unionByName(more), "ngram-links")
        forget(labels)
        labels = cut(components(all_links), "ngram-labels")
        forget(all_links)
    forget(first, second, links, more, active)
    return labels


def ngram_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, share: int = 75, bucket_tokens: int = 4_000_000, chunk_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, its row_key (hash of id and text) and whether it stands for its group (keep).

    A-Z goes to lower case; words are runs between ASCII white space; a text of fewer words than `width` has its whole
    word sequence as its one shingle. Documents link where 100 * intersection >= share * union; shingles are 64-bit
    numbers. A null or empty text, or one without words, has no shingles and is its own component; rows alike are one
    class; a null doc_id is in its class but never the smallest id of a component (null if all are null); an empty
    table gives no rows; other columns are not read. Python holds about `chunk_tokens` tokens at a time (or one text's)
    and one bucket's packed blocks; `bucket_tokens` sizes buckets; neither changes the result.
    """
    spark = docs.sparkSession
    base = small_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // bucket_tokens))
    back = cut(sent(base, width, buckets, chunk_tokens).groupBy("bucket").applyInArrow(lambda t: sent_back(t, buckets, chunk_tokens), f"bucket long, {_DOC}, classes binary, shared binary"), "ngram-shared")
    shown = back.filter("n is not null").select("doc_id", "row_key", "n", "class_id", "here")
    low = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("low")
    classes = cut(shown.filter("n > 0").groupBy("class_id").agg(F.min("row_key").alias("row_key"), F.min("n").alias("n"), F.min("here").alias("here"), low), "ngram-classes")
    counts = back.filter("shared is not null").select("bucket", "classes", "shared").groupBy("bucket").applyInArrow(sums, "class_id long, shared long").withColumnRenamed("class_id", "of_class")
    told = classes.join(counts, F.col("class_id") == F.col("of_class"), "left")
    alive = cut(told.filter(F.col("here") + F.coalesce("shared", F.lit(0)) >= F.ceil(F.col("n") * share / 100)).select("class_id", "row_key", "n"), "ngram-alive")
    packed = cut(class_sets(base, alive, width, buckets, chunk_tokens), "ngram-sets")
    members, sets = members_of(packed, share, buckets, chunk_tokens), packed.filter("n is not null").select("class_id", "n", "tokens")
    if sets.count() > alive.count():  # rows alike in id and text
        members, sets = members.dropDuplicates(["token", "class_id"]), cut(sets.dropDuplicates(["class_id"]), "ngram-sets")
    members = cut(members, "ngram-members")
    labels = component_labels(members, sets, share)
    forget(members, sets, packed, alive)
    named = classes.join(labels, F.col("class_id") == F.col("node"), "left").select("class_id", "low", F.coalesce("label", "class_id").alias("group"))
    smallest = named.groupBy(F.col("group").alias("of_group")).agg(F.min("low").alias("smallest"))
    of_class = named.join(smallest, F.col("group") == F.col("of_group")).select(F.col("class_id").alias("of_class"), "smallest")
    has = F.col("n") > 0
    out = shown.join(of_class, F.col("class_id") == F.col("of_class"), "left")
    keep = F.when(has, F.col("row_key") == F.col("smallest.row_key")).otherwise(True)
    out = cut(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(has, F.col("smallest.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_key", keep.alias("keep")), "ngram-groups")
    forget(back, classes, labels)
    return out


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one document of each group of ngram_groups(): that of the smallest doc_id (null last, then by hash).

    Texts without words all stay; of rows alike in id and text one stays.
    """
    groups = ngram_groups(docs, doc_id=doc_id, text=text, **how)
    keyed = docs.withColumn("_row_key", F.xxhash64(F.col(doc_id).cast("long"), text))
    goes = groups.filter(~F.col("keep")).select(F.col("row_key").alias("_goes")).distinct()
    left = keyed.join(small(goes, goes.count()), F.col("_row_key") == F.col("_goes"), "left_anti")
    if not groups.filter("keep").groupBy("row_key").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates(["_row_key"])
    return left.select(*docs.columns)
