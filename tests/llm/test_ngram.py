import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkcohort.llm.components import components
from sparkcohort.llm.ngram import blocks, coarse, deltas, linked, ngram_groups, one_of_each, pack, unpack
from sparkcohort.llm.shingles import shingle_sets


def sets_of(text):
    w = bytes(text or "", "utf-8").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = [sets_of(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)}


def got(spark, docs, **how):
    rows = ngram_groups(spark.createDataFrame(docs, "doc_id long, text string"), **how).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_families_passages_and_short_texts(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(70)]
    docs = []
    for family, (size, edits) in enumerate([(60, 3), (40, 6), (25, 9), (5, 2), (2, 1), (30, 12)]):
        base = [word() for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    docs += [" ".join([word() for _ in range(rng.randint(20, 90))] + passage) for _ in range(80)]
    docs += [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["one two", "ONE  two", "one two three", "", None, " \n"]
    docs = [(i * 3 + 1, t) for i, t in enumerate(docs)]
    rng.shuffle(docs)
    want = brute(docs)
    for chunk in (300, 2_000_000):  # many chunks and slices, and one
        assert got(spark, docs, chunk_tokens=chunk) == want


def test_short_texts_within_longer_ones(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    docs = []
    for n, m in [(48, 64), (48, 63), (47, 62), (47, 60), (46, 61), (45, 60), (43, 57), (48, 49)] * 12:
        longer = [word() for _ in range(m + 4)]
        at = rng.randrange(m - n + 1)
        docs += [" ".join(longer), " ".join(longer[at : at + n + 4])]
    common = [word() for _ in range(68)]  # a family whose shared tokens are all hot
    docs += [" ".join(common[i % 17 : i % 17 + 52]) for i in range(60)] + [" ".join(common)]
    docs = list(enumerate(docs))
    want = brute(docs)
    assert {n for n, _ in want.values()} >= {43, 48, 49, 64} and all(want[i][1] == i - 1 for i in range(1, 192, 2))
    for chunk in (500, 2_000_000):
        assert got(spark, docs, chunk_tokens=chunk) == want


def test_table(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(spark, docs) == brute(docs)


def test_copies_in_many_chunks(spark):
    copy = " ".join(f"c{i}" for i in range(40))
    docs = [(i, copy if i % 3 == 0 else " ".join(f"d{i}w{j}" for j in range(30))) for i in range(400)]
    for chunk in (100, 2_000_000):
        have = got(spark, docs, chunk_tokens=chunk)
        assert all(have[i] == ((36, 0) if i % 3 == 0 else (26, i)) for i in range(400))


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50, unique=True), st.integers(1, 5))
def test_packed_columns_come_back(values, buckets):
    low = np.array(sorted(values), np.uint32)
    for got, want in zip(unpack(pack(deltas(low), low[::-1]), len(low), 2), (deltas(low), low[::-1]), strict=True):
        assert (got == want).all()
    tokens = (low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    found = np.sort(coarse(tokens, buckets))
    assert sum(end - start for _, start, end in blocks(found)) == len(low) and all(0 <= b < buckets for b, _, _ in blocks(found))


def test_edges_and_one_of_each(spark, edges):
    rows = ngram_groups(edges).collect()
    assert len(rows) == edges.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert by[7].component_id == 6 and by[11].component_id == 10 and by[2].n_shingles == 0 and by[2].component_id == 2
    left = one_of_each(edges)
    assert left.columns == edges.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(5) == 1 and 7 not in ids and 11 not in ids and {1, 2, 3, 4, 6, 8, 9, 10} <= set(ids)
    assert ngram_groups(edges.limit(0)).count() == 0 and one_of_each(edges.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    for how in ({}, {"one_task": 0}):
        got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long"), **how).collect()}
        assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.sets(st.integers(-(2**60), 2**60), min_size=1, max_size=40), st.sets(st.integers(-(2**60), 2**60), max_size=8), st.sets(st.integers(-(2**60), 2**60), max_size=8))
@settings(max_examples=200)
def test_sets_link_as_their_counts_say(common, x, y):
    a, b = (np.array(sorted(common | s), np.int64) for s in (x, y))
    n = len(set(a.tolist()) & set(b.tolist()))
    assert linked(a, b, 75) == (100 * n >= 75 * (len(a) + len(b) - n))


@given(st.lists(st.text(alphabet="aAb \n\t\x0bé", max_size=40), max_size=6))
def test_shingle_counts(texts):
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(sets_of(t)) for t in texts]
