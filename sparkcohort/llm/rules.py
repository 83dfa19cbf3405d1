"""Quality rules as weak supervision: rules vote or abstain, EM finds their accuracies, the posterior decides.

Every rule votes good where its ratio looks sound, bad where it does not, and abstains between. One pass over the texts
gives counts and votes. A vote pattern is one of 3^rules, so the rows are counted by pattern, the few patterns go to the
driver, EM runs there on counts, and the posterior of each pattern is joined back by broadcast (3^rules rows at most,
whatever the corpus). EM learns from the documents that pass the base rule: the others are out already, and their
repetition would take one of the two classes for itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.shared import cut, small_batches, tidied

SYMBOLS = "#*$%&|<>"
HAS_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("word_length", "symbols", "duplicate_lines", "repeats", "capitals", "exclamations", "lettered_words", "variety")
#: (good from, good to, bad below, bad above) of each rule's ratio; between them it abstains.
DEFAULT_LIMITS = {
    "word_length": (3.5, 7.0, 3.0, 10.0),
    "symbols": (0.0, 0.02, 0.0, 0.15),
    "duplicate_lines": (0.0, 0.1, 0.0, 0.3),
    "repeats": (0.0, 0.05, 0.0, 0.25),
    "capitals": (0.0, 0.1, 0.0, 0.4),
    "exclamations": (0.0, 0.02, 0.0, 0.1),
    "lettered_words": (0.0, 0.05, 0.0, 0.2),
    "variety": (0.85, 1.0, 0.7, 1.0),
}
#: P(good, bad, abstains | bad), the same of good, before any vote is seen: better than chance, at the weight of STRENGTH rows.
PRIOR = ((0.3, 0.35, 0.35), (0.6, 0.05, 0.35))
STRENGTH = 5.0


def repeated_words(words: list[bytes]) -> tuple[int, dict[bytes, int], np.ndarray]:
    """Words that lie in a 3-word window found twice or more; the distinct words and the words as numbers."""
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(words) < 4:
        return 0, ids, numbers
    k = len(ids)
    pairs = numbers[:-1] * k + numbers[1:]
    if k > 2_000_000:  # the third power would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, count = np.unique(pairs[:-1] * k + numbers[2:], return_inverse=True, return_counts=True)
    again = count[where] > 1
    cover = np.zeros(len(words), bool)
    for shift in range(3):
        cover[shift : shift + len(again)] |= again
    return int(cover.sum()), ids, numbers


def text_counts(text: bytes) -> tuple[list[int], list[float | None]]:
    """The counts of COUNTS, and each rule's ratio (None: it abstains)."""
    words, said = text.split(), text.decode()
    n = len(words)
    n_repeat, ids, numbers = repeated_words(words)
    word_chars = len(said) - sum(map(said.count, " \t\n\v\f\r"))
    n_symbols = sum(map(said.count, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    if not n:
        return [0, 0, n_symbols, 0, 0], [None] * len(RULES)
    per_id = np.bincount(numbers, minlength=len(ids))
    lettered = sum(int(c) for w, c in zip(ids, per_id, strict=True) if HAS_LETTER.search(w))
    capital = sum(int(c) for w, c in zip(ids, per_id, strict=True) if len(w) > 1 and w.isupper())
    ratios = [word_chars / n, n_symbols / n, n_dup / len(lines) if len(lines) > 1 else None, n_repeat / n, capital / n, said.count("!") / n, 1 - lettered / n, math.log(len(ids)) / math.log(n) if n >= 50 else None]
    return [n, word_chars, n_symbols, n_dup, n_repeat], ratios


def votes(ratios: list[float | None], limits: dict[str, tuple[float, float, float, float]]) -> str:
    """One character for each rule: g(ood), b(ad) or - (abstains)."""
    out = []
    for rule, x in zip(RULES, ratios, strict=True):
        if x is None:
            out.append("-")
            continue
        good_from, good_to, low, high = limits[rule]
        out.append("g" if good_from <= x <= good_to else "b" if x < low or x > high else "-")
    return "".join(out)


def fit_patterns(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each vote pattern, P(vote | class) as [bad, good][rule][g, b, -], and the share of good.

    Given the class the rules vote independently, each with its own chances of good, bad and abstaining; patterns count
    as many rows as they say, also none. EM starts from PRIOR, which says no more than that rules are better than chance
    and so which class is which; the rows then decide how much a vote weighs, and many good votes may outweigh a bad one.
    """
    prior = np.array(PRIOR)
    theta = np.repeat(prior[:, None, :], len(RULES), axis=1)
    if not patterns:
        return {}, theta, 0.5
    keys = sorted(patterns)
    weight = np.array([patterns[k] for k in keys], float)
    cast = np.array([[[c == x for x in "gb-"] for c in k] for k in keys], float)
    good = 1 / (1 + np.exp(-(cast @ np.log(prior[1] / prior[0])).sum(1)))
    share = 0.5
    for _ in range(rounds):
        share = float((weight @ good + 1) / (weight.sum() + 2))
        for y, p in ((0, 1 - good), (1, good)):
            theta[y] = np.einsum("k,kjv->jv", weight * p, cast) + STRENGTH * prior[y]
            theta[y] /= theta[y].sum(1, keepdims=True)
        score = np.log(share / (1 - share)) + (cast * np.log(theta[1] / theta[0])).sum((1, 2))
        good = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
    return dict(zip(keys, map(float, good), strict=True)), theta, share


def score_quality(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limits: dict[str, tuple[float, float, float, float]] | None = None, keep_from: float = 0.5) -> DataFrame:
    """Counts, votes and posterior quality of each document; kept where the base rule passes and posterior >= keep_from.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, votes, posterior.
    A null or empty text has zero counts, no votes and fails the base rule (n_words < 50); rows alike are scored
    alike; a null doc_id stays; an empty table gives no rows; other columns are not read. Whole texts are read.
    """
    spark = docs.sparkSession
    edges = DEFAULT_LIMITS | (limits or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, cast = [], []
            for body in batch.column(1).cast(pa.binary()).to_pylist():
                c, ratios = text_counts(body or b"")
                counts.append(c)
                cast.append(votes(ratios, edges))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(5)], pa.array(cast, pa.string())], names=["doc_id", *COUNTS, "votes"])

    counted = cut(small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, votes string"), "rules")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    patterns = {r["votes"]: r["passing"] for r in counted.groupBy("votes").agg(F.count_if(~failed).alias("passing")).collect()}  # 3^rules at most
    posterior, _, _ = fit_patterns(patterns)
    by_pattern = spark.createDataFrame(sorted(posterior.items()), "pattern string, posterior double")
    joined = counted.join(F.broadcast(by_pattern), F.col("votes") == F.col("pattern"), "left").withColumn("base_failed", failed)
    return joined.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep_from)).alias("kept"), "votes", "posterior")
