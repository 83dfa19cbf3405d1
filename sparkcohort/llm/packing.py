"""Packing documents into windows of fixed length by the sum-of-squares rule.

Each task is an online packer over its own rows: it keeps an array with the number of open windows of every
fill level and puts a document where the sum of the squared counts grows least (into a new window, or on top of
a level). What is longer than a window first fills whole windows. Tasks share nothing, so there is no shuffle;
at its end (or when too many windows are open) a task fills its fullest windows with pieces cut from its
emptiest, and cuts what is left into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import threading
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.shared import small_batches, tidy

#: Sequences of one task are numbered from its partition's number times this.
STRIDE = 1 << 33
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def load_tokenizer(path: str | None):
    """A tokenizer of the `tokenizers` library; by default the public word-end BPE of the installed package."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


class _Seen(dict):
    """Numbers words in the order of their first sight and lists the new ones."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Ids of texts, each distinct word encoded once while it stays in a bounded memo.

    The tokenizer never joins across white space, so a text's ids are its words' ids in a row; and letters and a
    mark after them are separate tokens, so a word that ends in one shares the ids of its letters.
    """

    def __init__(self, path: str | None, most_words: int = 1_600_000) -> None:
        self.tokenizer, self.most_words = load_tokenizer(path), most_words
        self.marks = {m: self._ids([m])[0] for m in ".,"}
        self.stems: dict[str, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        self.seen = _Seen()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.count = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _parts(word: bytes) -> tuple[str, str]:
        """Letters and the mark after them where a word has that form, else the word and nothing. ASCII goes to lower case, as in the tokenizer."""
        text = word.decode()
        if text[-1] in ".," and text[:-1].isalpha():
            return (text[:-1].lower() if word.isascii() else text[:-1]), text[-1]
        return (text.lower() if word.isascii() and text.isalpha() else text), ""

    def _learn(self) -> None:
        new, self.seen.new = self.seen.new, []
        parts = list(map(self._parts, new))
        if len(self.stems) > 3 * self.most_words // 4:
            self.stems.clear()
        missing = list({stem for stem, _ in parts if stem not in self.stems})
        for at in range(0, len(missing), 10_000):
            self.stems.update(zip(missing[at : at + 10_000], self._ids(missing[at : at + 10_000]), strict=True))
        stems, marks = self.stems, self.marks
        found = [stems[stem] + marks[mark] if mark else stems[stem] for stem, mark in parts]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        values = np.frombuffer(b"".join(found), np.uint32)
        base = len(self.seen) - len(new)
        while len(self.seen) > len(self.first):
            self.first, self.count = np.concatenate([self.first, self.first]), np.concatenate([self.count, self.count])
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.first[base : len(self.seen)] = self.used + np.cumsum(counts) - counts
        self.count[base : len(self.seen)] = counts
        self.flat[self.used : self.used + len(values)] = values
        self.used += len(values)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        # of bytes: at ASCII white space only; ASCII goes to lower case in the tokenizer too, but for special tokens' names
        words = [(t.lower() if t.isascii() and b"<|" not in t else t).split() for t in texts]
        if len(self.seen) > self.most_words:
            self._reset()
        ends = np.cumsum([len(w) for w in words])
        index = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(words)), np.int64, int(ends[-1]) if len(ends) else 0)
        if self.seen.new:
            self._learn()
        counts = self.count[index]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.first[index] - upto[:-1], counts) + np.arange(upto[-1])]
        return np.split(ids, upto[ends[:-1]])


@lru_cache(maxsize=2)
def word_encoder(path: str | None, most_words: int = 1_600_000) -> WordEncoder:
    """One encoder for all tasks of a worker: what one has learned serves the next."""
    return WordEncoder(path, most_words)


def forget_words() -> None:
    word_encoder.cache_clear()
    tidy()


class Lease:
    """Holds the worker's encoder; when none has held it for a while, its memo is given back, as workers outlive stages."""

    timer: threading.Timer | None = None

    def __init__(self, path: str | None, most_words: int, idle_seconds: float = 20.0) -> None:
        self.path, self.most_words, self.idle_seconds = path, most_words, idle_seconds

    def __enter__(self) -> WordEncoder:
        if Lease.timer:
            Lease.timer.cancel()
        return word_encoder(self.path, self.most_words)

    def __exit__(self, *_) -> None:
        Lease.timer = threading.Timer(self.idle_seconds, forget_words)
        Lease.timer.daemon = True
        Lease.timer.start()


def portions(bodies: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes."""
    start = held = 0
    for at, body in enumerate(bodies):
        held += len(body)
        if held >= most:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(bodies):
        yield start, len(bodies)


class Packer:
    """One task's windows. A piece is (doc_id, start, ids, doc_tokens); done sequences are lists of pieces."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open, self.n_open = capacity, most_open, 0
        self.level = np.zeros(capacity + 1, np.int64)  # open windows at each fill; 0 and the capacity stay 0
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.done: list[list] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self.done.append([(doc_id, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        if start < total:
            self._place((doc_id, start, ids[start:], total))

    def _place(self, piece: tuple) -> None:
        size, n = len(piece[2]), self.level
        top = self.capacity - size
        # growth of the sum of squares when a window of fill h gets the piece; h = 0 is a new window
        growth = 2 * n[size : self.capacity + 1] + 1
        growth[top] = 0
        growth[1:] -= np.where(n[1 : top + 1] > 0, 2 * n[1 : top + 1] - 1, -(1 << 40))
        h = len(growth) - 1 - int(growth[::-1].argmin())  # of equals the fullest
        window = self.windows[h].pop() if h else []
        if h:
            n[h] -= 1
            self.n_open -= 1
        window.append(piece)
        if h + size == self.capacity:
            self.done.append(window)
            return
        n[h + size] += 1
        self.n_open += 1
        self.windows[h + size].append(window)
        if self.n_open > self.most_open:
            self._merge()

    def _merge(self) -> None:
        """Fill the fullest windows with pieces of the emptiest; one window at most stays open."""
        queue = [(h, w) for h in range(1, self.capacity) for w in self.windows[h]]
        for h in range(1, self.capacity):
            self.windows[h].clear()
        self.level[:] = 0
        lo, hi = 0, len(queue) - 1
        while lo < hi:
            fill, window = queue[hi]
            while fill < self.capacity and lo < hi:
                small, giver = queue[lo]
                doc_id, start, ids, total = giver.pop()
                take = min(len(ids), self.capacity - fill)
                window.append((doc_id, start + len(ids) - take, ids[len(ids) - take :], total))
                if take < len(ids):
                    giver.append((doc_id, start, ids[: len(ids) - take], total))
                fill += take
                queue[lo] = (small - take, giver)
                if not giver:
                    lo += 1
            if fill == self.capacity:
                self.done.append(window)
                hi -= 1
            else:
                queue[hi] = (fill, window)
        self.n_open = 0
        if lo == hi:
            fill, window = queue[lo]
            if fill == self.capacity:
                self.done.append(window)
            else:
                self.windows[fill].append(window)
                self.level[fill] = self.n_open = 1

    def close(self) -> None:
        self._merge()
        for fill in range(1, self.capacity):
            for window in self.windows[fill]:
                pieces, rest = window[::-1], fill
                while rest:
                    room = 1 << (rest.bit_length() - 1)
                    rest -= room
                    sequence: list = []
                    while room:
                        doc_id, start, ids, total = pieces.pop()
                        take = min(room, len(ids))
                        sequence.append((doc_id, start, ids[:take], total))
                        if take < len(ids):
                            pieces.append((doc_id, start + take, ids[take:], total))
                        room -= take
                    self.done.append(sequence)
            self.windows[fill] = []


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, most_open: int = 1024, memo_words: int = 1_600_000) -> DataFrame:
    """Pieces of all documents, each with its sequence and place there.

    Returns doc_id, start, length, ids (little-endian unsigned 32-bit, as binary), doc_tokens, sequence_id, offset.
    A null or empty text is the end id alone; a null doc_id stays null; rows alike are packed each; an empty table
    gives no rows; other columns are not read. A task holds its open windows (most_open at most), one batch and
    a memo of memo_words words (about 250 bytes each).
    Every sequence but those whose length is a power of two has `capacity` tokens.
    """
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Lease(tokenizer, memo_words) as encode:
            yield from packed(batches, encode)

    def packed(batches: Iterator[pa.RecordBatch], encode: WordEncoder) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, most_open)
        sequence = TaskContext.get().partitionId() * STRIDE

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            cols: list[list] = [[] for _ in range(7)]
            for pieces in packer.done:
                offset = 0
                for owner, start, ids, total in pieces:
                    for col, v in zip(cols, (owner, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset), strict=True):
                        col.append(v)
                    offset += len(ids)
                sequence += 1
            packer.done = []
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            owners, bodies = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in portions(bodies):
                for owner, ids in zip(owners[lo:hi], encode(bodies[lo:hi]), strict=True):
                    packer.add(owner, np.concatenate([ids, end]))
                    if len(packer.done) >= 256:
                        yield from flush()
        packer.close()
        yield from flush()

    assert kind.typeName() in ("long", "integer", "short", "byte"), f"{doc_id} must be an integer"
    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
