from collections import Counter

import numpy as np

from sparkcohort.llm.rules import PRIOR, RULES, STRENGTH, fit_patterns, score_quality, text_counts


def brute(text):
    t = text or ""
    w = t.encode().split()
    windows = Counter(zip(w, w[1:], w[2:]))
    cover = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return [len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(cover)]


def test_counts_equal_brute_force(documents, edges):
    for docs in (documents, edges):
        texts = Counter((r.doc_id, tuple(brute(r.text))) for r in docs.collect())
        rows = score_quality(docs).collect()
        assert texts == Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows)
        for r in rows:
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and r.kept == (not failed and r.posterior >= 0.5)


def test_verdicts_agree_with_labels(documents, labels):
    rows = score_quality(documents).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.98 * len(rows)


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(5)
    good_if = np.array([[0.8, 0.05], [0.9, 0.02], [0.7, 0.1], [0.95, 0.01], [0.6, 0.05], [0.85, 0.1], [0.9, 0.05], [0.75, 0.02]])  # P(g), P(b) of good rows
    bad_if = np.array([[0.2, 0.6], [0.1, 0.8], [0.4, 0.3], [0.3, 0.5], [0.2, 0.2], [0.1, 0.7], [0.5, 0.4], [0.3, 0.4]])
    rows, truth = Counter(), {}
    for is_good in (rng.random(40_000) < 0.8).tolist():
        table = good_if if is_good else bad_if
        u = rng.random(len(RULES))
        pattern = "".join("g" if x < g else "b" if x < g + b else "-" for x, (g, b) in zip(u, table))
        rows[pattern] += 1
        truth.setdefault(pattern, []).append(is_good)
    posterior, theta, share = fit_patterns(rows)
    assert abs(share - 0.8) < 0.02
    assert np.abs(theta[1][:, :2] - good_if).max() < 0.03 and np.abs(theta[0][:, :2] - bad_if).max() < 0.05
    right = sum((posterior[p] >= 0.5) == t for p, ts in truth.items() for t in ts)
    assert right > 0.97 * 40_000
    one_bad = [p for p in posterior if p.count("b") == 1]
    assert any(posterior[p] >= 0.5 for p in one_bad) and any(posterior[p] < 0.5 for p in posterior if "b" in p)


def test_em_equals_brute_force_over_rows():
    patterns = {"gggggggg": 30, "gb-ggg-g": 5, "bbb--b-b": 7, "ggb-gggg": 2, "g-------": 0}
    rows = [p for p, n in patterns.items() for _ in range(n)]
    prior = {1: dict(zip("gb-", PRIOR[1])), 0: dict(zip("gb-", PRIOR[0]))}
    belief = []
    for p in rows:
        odds = np.prod([prior[1][v] / prior[0][v] for v in p])
        belief.append(odds / (1 + odds))
    for _ in range(100):
        share = (sum(belief) + 1) / (len(rows) + 2)
        chance = {}
        for y in (0, 1):
            w = [b if y else 1 - b for b in belief]
            for j in range(len(RULES)):
                raw = {v: sum(x for x, p in zip(w, rows) if p[j] == v) + STRENGTH * prior[y][v] for v in "gb-"}
                chance[y, j] = {v: x / sum(raw.values()) for v, x in raw.items()}

        def posterior(p):
            odds = share / (1 - share) * np.prod([chance[1, j][v] / chance[0, j][v] for j, v in enumerate(p)])
            return odds / (1 + odds)

        belief = [posterior(p) for p in rows]
    got, _, _ = fit_patterns(patterns)
    assert all(abs(got[p] - posterior(p)) < 1e-6 for p in patterns)


def test_a_bad_vote_may_be_outvoted_and_long_texts_are_judged(spark):
    rng = np.random.default_rng(3)
    words = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(600)]
    clean = lambda n: "\n".join(" ".join(rng.choice(words, 12)).capitalize() + "." for _ in range(n))
    docs = [(i, clean(8)) for i in range(60)]
    docs += [(100 + i, " ".join(f"#{w}" for w in rng.choice(words, 90)) + " 12 " * 40) for i in range(15)]
    docs += [(200, clean(8) + "\nyes yes.\nyes yes.\nyes yes.\nyes yes.\nyes yes."), (300, " ".join(rng.choice(words[:3], 5000)))]
    rows = {r.doc_id: r for r in score_quality(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(rows[i].kept for i in range(60)) and not any(rows[100 + i].kept for i in range(15))
    assert rows[200].votes.count("b") == 1 and rows[200].kept
    assert rows[300].votes[RULES.index("variety")] == "b"


def test_empty(edges):
    assert score_quality(edges.limit(0)).count() == 0
    assert text_counts(b"")[0] == [0, 0, 0, 0, 0]
