from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkcohort.llm.packing import Packer, WordEncoder, load_tokenizer, pack_documents


def check(rows, docs, capacity=4096):
    tokenizer = load_tokenizer(None)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    wanted = defaultdict(list)
    for i, text in docs:
        wanted[i].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    for i, bodies in wanted.items():
        if len(bodies) == 1:
            own = sorted(pieces[i], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in own) == bodies[0]
            at = 0
            for r in own:
                assert r.start == at and r.doc_tokens == len(bodies[0]) // 4 and r.length == len(r.ids) // 4
                at += r.length
        else:
            assert sum(r.length for r in pieces[i]) * 4 == sum(map(len, bodies))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0 and at < capacity


def test_table_and_edges(documents, edges, edge_rows):
    check(pack_documents(documents).collect(), [(r.doc_id, r.text) for r in documents.collect()])
    check(pack_documents(edges).collect(), [(i, t) for i, t, _ in edge_rows])
    assert pack_documents(edges.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB. ,\n\t'é\u0301\u030cJΣσςİ<|>endoftext1😀\u00a0\u2003")), max_size=60))
def test_word_by_word_ids_are_the_whole_texts(text):
    want = load_tokenizer(None).encode(text, add_special_tokens=False).ids
    assert WordEncoder(None)([text.encode()])[0].tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=80), st.integers(1, 20))
def test_packer_keeps_every_token_once(sizes, most_open):
    p = Packer(64, most_open)
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype=np.uint32))
    p.close()
    seen = defaultdict(list)
    for seq in p.done:
        n = sum(len(ids) for _, _, ids, _ in seq)
        assert n == 64 or n & (n - 1) == 0
        for i, start, ids, total in seq:
            assert total == sizes[i] and ids[0] == start
            seen[i] += ids.tolist()
    assert all(sorted(seen[i]) == list(range(n)) for i, n in enumerate(sizes))
