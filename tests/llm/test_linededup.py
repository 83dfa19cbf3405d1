import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkcohort.llm.linededup import common_blocks, dedup_lines, longest_run, patience

P = "passage " + " ".join(f"w{i}" for i in range(60))
Q = "second " + " ".join(f"v{i}" for i in range(30))
R = "third " + " ".join(f"u{i}" for i in range(30))


@given(st.lists(st.integers(0, 30), max_size=30, unique=True))
def test_longest_run_is_longest(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] += max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    run = longest_run(values)
    picked = [values[i] for i in run]
    assert picked == sorted(set(picked)) and len(run) == max(best, default=0)


@settings(max_examples=200)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    m = patience(a, b)
    assert all(a[i] == b[j] for i, j in m)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
    assert bool(m) == bool(set(a) & set(b))


def test_moved_blocks_go_too():
    later = [(0, 7, 60), (1, 8, 60), (2, 1, 5), (3, 5, 60), (4, 6, 60)]
    assert sorted(common_blocks([(0, 5), (1, 6), (2, 7), (3, 8)], later, 50)) == [0, 1, 3, 4]


def run(spark, docs, **how):
    rows = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), **how).collect()
    return {r.doc_id: (r.text, r.n_lines, r.n_removed, r.words_left) for r in rows}


def test_later_document_loses_the_passage(spark):
    docs = [(1, f"intro one\n{P}\nend one"), (2, f"intro two\n{P}\nend two"), (3, f"{Q}\n{R}\nx"), (4, f"a\n{Q}\n{R}"), (5, f"{Q}\nb\n{R}"), (6, "intro one\nshort"), (7, f"intro two\n{P}\nend two")]
    got = run(spark, docs)
    assert got[1][0] == docs[0][1] and got[2] == ("intro two\nend two", 3, 1, 4)
    assert got[3][0] == docs[2][1] and got[4][0] == "a"
    assert got[5][0] == docs[4][1]  # two blocks of 31 words, each below 50
    assert got[6][2] == 0 and got[7] == ("", 3, 3, 0)  # all of it is a copy of document 2


def test_line_in_very_many_documents(spark):
    got = run(spark, [(i, f"head {i}\n{P}") for i in range(500)])
    assert got[0][2] == 0 and all(got[i][0] == f"head {i}" for i in range(1, 500))


def test_exact_copies_and_edges(spark, edges):
    rows = dedup_lines(edges).collect()
    assert len(rows) == edges.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert by[1].text is None and by[2].text == "" and by[5].n_removed == 0
    assert by[6].n_removed == 0 and by[7].words_left == 0
    assert dedup_lines(edges.limit(0)).count() == 0


def test_no_shared_passage_is_left_where_lines_are_whole(documents):
    seen: dict = {}
    for r in sorted(dedup_lines(documents).collect(), key=lambda r: r.doc_id):
        for line in set((r.text or "").split("\n")):
            if len(line.split()) >= 50:
                assert line not in seen, (r.doc_id, seen[line])
                seen[line] = r.doc_id


def brute(docs, least=50):
    """Words left: every run of lines with a word that an earlier document has goes, from `least` words on."""
    out, earlier = {}, []
    for i, text in docs:
        lines = [x for x in text.split("\n") if x.split()]
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = lines[a:b]
                if sum(len(x.split()) for x in run) >= least and any(run == e[k : k + b - a] for e in earlier for k in range(len(e))):
                    gone |= set(range(a, b))
        out[i] = sum(len(x.split()) for k, x in enumerate(lines) if k not in gone)
        earlier.append(lines)
    return out


def test_copy_of_a_document_whose_lines_were_all_seen_elsewhere(spark):
    a, b = ([f"{c}{i} " + " ".join(f"{c}{i}w{j}" for j in range(7)) for i in range(5)] for c in "ab")
    docs = [(1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join(a + b)), (4, "\n".join(a + b)), (5, "\n".join([*a, "one more", *b]))]
    got = run(spark, docs)
    assert got[3][2] == 0 and got[4] == ("", 10, 10, 0) and got[5][2] == 0


def test_equals_brute_force_over_all_earlier_documents(spark):
    rng = random.Random(3)
    alphabet = [" ".join(f"l{i}w{j}" for j in range(rng.choice([3, 8, 20, 30, 60]))) for i in range(14)]
    docs = [(i, "\n".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    for i in range(3, 120, 4):  # passages of earlier documents, in another place
        taken = docs[rng.randrange(i)][1].split("\n")
        docs[i] = (i, "\n".join([rng.choice(alphabet), *taken[rng.randrange(len(taken)) :], rng.choice(alphabet)]))
    assert {i: x[3] for i, x in run(spark, docs).items()} == brute(docs)


def test_blank_lines_end_no_block(spark):
    parts = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(4)]
    docs = [(1, "head\n" + "\n\n".join(parts) + "\nend"), (2, "\n \t\n\n".join(parts)), (3, "other\n\n" + "\n".join(parts) + "\n\nlast"), (4, "\n\n".join([parts[0], "new", parts[1]]))]
    got = run(spark, docs)
    assert got[1][0] == docs[0][1] and got[4][0] == docs[3][1]
    assert got[2] == ("\n".join([" \t", ""] * 3), 10, 4, 0)
    assert got[3] == ("other\n\n\nlast", 8, 4, 2)
