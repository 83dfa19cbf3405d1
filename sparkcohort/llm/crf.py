"""Quality classifier: a linear-chain conditional random field that labels every line good or bad.

A line is described by its own features and those of the lines beside it; two transition weights tie neighbouring
labels. A document's score is the mean, weighted by length, of its lines' marginal chances of good from
forward-backward. The field is fitted on the driver over a bounded sample of labelled documents; scoring is one
pass of each task over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkcohort.llm.shared import small_batches, tidied

SYMBOLS = b"#*$%&|<>"
FEATURES = 15


def line_features(line: bytes, seen: bool) -> tuple[float, ...]:
    """Shape of a line; nothing of which language or which words."""
    words = line.split()
    n = len(words)
    if not n:
        return (1.0, *[0.0] * (FEATURES - 2), 1.0)
    clean = line.translate(None, SYMBOLS)
    symbols, size = len(line) - len(clean), len(line)
    return (
        1.0,
        math.log1p(n) / 4,
        min(2.0, size / n / 8),
        len(set(words)) / n if n > 4 else 0.8,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(map(bytes.isupper, words)) / n,
        min(2.0, line.count(b"!") / n),
        min(3.0, symbols / n),
        min(2.0, line.count(b"|") / n),
        (size - len(line.translate(None, b"0123456789"))) / size * 4,
        1.0 if line.rstrip()[-1:] in (b".", b"!", b"?", b'"') else 0.0,
        1.0 if words[0][:1].isupper() or words[0][0] > 127 else 0.0,
        min(1.0, (line.count(b",") + line.count(b".")) / n),
        1.0 if seen else 0.0,
        0.0,
    )


def document_features(text: bytes) -> tuple[np.ndarray, list[int]]:
    """Features of the \\n-split lines and their lengths in bytes."""
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    rows = []
    for line in lines:
        rows.append(line_features(line, line in seen))
        seen.add(line)
    return np.array(rows), [len(x) for x in lines]


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, the line before's and the line after's. first: whether a row starts a document."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1]
    before[first] = 0
    after[:-1] = x[1:]
    after[np.append(first[1:], True)] = 0
    return np.hstack([x, before, after])


def windows(lines: int, most: int, parts: int = 4) -> list[tuple[int, int]]:
    """Ranges of at most `most` of the lines: all, or `parts` windows spread evenly from the first line to the last."""
    if lines <= most:
        return [(0, lines)]
    size = max(1, most // parts)
    return [(s, s + size) for s in sorted({round(i * (lines - size) / (parts - 1)) for i in range(parts)})]


def chances(u: list[float], stay: tuple[float, float]) -> list[float]:
    """Marginals of good by forward-backward. u: log odds of each line alone; stay: weights of good-good and bad-bad."""
    gg, bb = math.exp(stay[0]), math.exp(stay[1])
    odds = [math.exp(max(-30.0, min(30.0, x))) for x in u]
    forward, a = [], 1.0
    for i, e in enumerate(odds):
        a = e * ((a * gg + 1) / (a + bb) if i else 1.0)
        a = min(1e12, max(1e-12, a))
        forward.append(a)
    out, b = [0.0] * len(u), 1.0
    for i in range(len(u) - 1, -1, -1):
        r = forward[i] * b
        out[i] = r / (1 + r)
        eb = odds[i] * b
        b = min(1e12, max(1e-12, (gg * eb + 1) / (eb + bb)))
    return out


def fit(docs: list[np.ndarray], labels: list[int], rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, tuple[float, float]]:
    """Weights of log odds and of staying good or bad, by Adam on the likelihood of the line labels (their document's).

    docs: with_neighbours() of each. Documents side by side, padded; forward-backward runs over all at once.
    """
    longest = max(map(len, docs))
    n, width = len(docs), docs[0].shape[1]
    x, mask = np.zeros((n, longest, width)), np.zeros((n, longest), bool)
    for i, d in enumerate(docs):
        x[i, : len(d)], mask[i, : len(d)] = d, True
    y = np.array(labels, float)
    total = mask.sum()
    w = np.zeros(width + 2)
    m, v = np.zeros_like(w), np.zeros_like(w)
    pairs = mask[:, 1:]
    for step in range(1, rounds + 1):
        odds = np.exp(np.clip(x @ w[:-2], -30, 30))
        gg, bb = np.exp(w[-2]), np.exp(w[-1])
        forward, backward = np.ones((n, longest)), np.ones((n, longest))
        forward[:, 0] = odds[:, 0]
        for t in range(1, longest):
            a = forward[:, t - 1]
            forward[:, t] = np.clip(odds[:, t] * (a * gg + 1) / (a + bb), 1e-12, 1e12)
        for t in range(longest - 2, -1, -1):
            eb = odds[:, t + 1] * backward[:, t + 1]
            backward[:, t] = np.where(mask[:, t + 1], np.clip((gg * eb + 1) / (eb + bb), 1e-12, 1e12), 1.0)
        good = forward * backward / (1 + forward * backward)
        eb, a = odds[:, 1:] * backward[:, 1:], forward[:, :-1]
        z = a * gg * eb + a + eb + bb
        both_good, both_bad = np.where(pairs, a * gg * eb / z, 0), np.where(pairs, bb / z, 0)
        grad = np.append(np.einsum("ntf,nt->f", x, (y[:, None] - good) * mask), [(y[:, None] * pairs - both_good).sum(), ((1 - y)[:, None] * pairs - both_bad).sum()]) / total - ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-2], (float(w[-2]), float(w[-1]))


def score_documents(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", label_id: str = "doc_id", held_out: int | None = 1, train_docs: int = 1200, train_lines: int = 64, carry: Sequence[str] = ()) -> DataFrame:
    """Quality of every document: the columns named in `carry`, doc_id, held_out, score, predicted.

    Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not `held_out` (None: from all). The
    sample: per class the train_docs documents of the smallest hashes, train_lines lines of each; both bounds are
    parameters, as fitting happens on the driver. Labels other than 0 and 1 and null ids teach nothing; a document
    with both counts by its lowest. With labels of one class only, or none, every score is that share's prior.
    A null or text without any character scores the share of label 1 among the labels learned from; rows alike
    score alike; an empty table gives no rows; other columns are not read. Whole texts are scored.
    """
    fold = lambda c: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(3))
    told = labels.filter(F.col(quality).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("told_id")).agg(F.min(quality).cast("int").alias("y"))
    if held_out is not None:
        told = told.filter(fold(F.col("told_id")) != held_out)
    share = told.agg(F.avg("y")).first()[0]
    prior = 0.5 if share is None else float(share)
    base = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    picked = [r for y in (0, 1) for r in told.filter(F.col("y") == y).orderBy(F.xxhash64("told_id"), "told_id").limit(train_docs).collect()]
    model = None
    if {r["y"] for r in picked} == {0, 1}:
        chosen = docs.sparkSession.createDataFrame([(r["told_id"], r["y"]) for r in picked], "told_id long, y int")  # 2 * train_docs rows at most

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ys, xs = [], []
                for body, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    x = document_features(body)[0]
                    x = with_neighbours(x, np.arange(len(x)) == 0).astype("<f4")
                    for start, end in windows(len(x), train_lines):
                        ys.append(y)
                        xs.append(x[start:end].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(xs, pa.binary())], names=["y", "x"])

        texts = base.filter("text <> ''").join(F.broadcast(chosen), F.col("doc_id") == F.col("told_id")).groupBy("told_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"), F.min("y").alias("y"))
        got = sorted((r["y"], bytes(r["x"])) for r in texts.select("first.text", "y").mapInArrow(tidied(sample), "y int, x binary").collect())  # 4 windows of 2 * train_docs texts at most
        if {y for y, _ in got} == {0, 1}:
            model = fit([np.frombuffer(x, "<f4").reshape(-1, 3 * FEATURES) for _, x in got], [y for y, _ in got])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for body in batch.column(1).cast(pa.binary()).to_pylist():
                if not body or model is None:
                    scores.append(prior)
                    continue
                x, lengths = document_features(body)
                u = with_neighbours(x, np.arange(len(x)) == 0) @ model[0]
                weight = [max(1, n) for n in lengths]
                good = chances(u.tolist(), model[1])
                scores.append(sum(map(float.__mul__, good, map(float, weight))) / sum(weight))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(scores, pa.float64())], names=["doc_id", *more, "score"])

    held = fold(F.col("doc_id")) == held_out if held_out is not None else F.lit(False)
    more = [f"_carried{i}" for i in range(len(carry))]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(m) for c, m in zip(carry, more, strict=True)])
    kind = StructType([f for f in rows.schema if f.name != "text"]).add("score", "double")
    scored = rows.mapInArrow(tidied(run), kind)
    return scored.select(*[F.col(m).alias(c) for c, m in zip(carry, more, strict=True) if c != doc_id], "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
