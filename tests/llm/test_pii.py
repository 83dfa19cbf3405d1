import hashlib
import random
import re

from sparkcohort.llm.pii import KINDS, find_pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


def same(rows, texts):
    for r in rows:
        for kind, spans in brute(texts[r.doc_id]).items():
            assert [(x.s, x.e) for x in r[kind]] == spans, (kind, texts[r.doc_id][:80])


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(1)
    texts = [None, "", "a@b.c-d_@e.ff 1.2.3.4.5.6.7.8 256.1.1.1 0001.0.0.255 é😀 x@y.zz", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111", "+1 (555) 123-4567) +12 +1234567890123456 + 12345678", "a" * 100_000 + "@", "1" * 30_000, "9 " * 10_000, "@".join(["a.b"] * 300), " ".join(f"u{i}@ex.com" for i in range(3000))]
    texts += ["".join(rng.choice("a1@.+- ()é\n%_25") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    same(find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), dict(enumerate(texts)))


def test_table_and_edges(documents, edges):
    same(find_pii(documents).collect(), {r.doc_id: r.text for r in documents.collect()})
    rows = find_pii(edges).collect()
    assert len(rows) == edges.count() and all(not r[k] for r in rows for k in KINDS)
    assert find_pii(edges.limit(0)).count() == 0


def test_contexts_discover_values_that_are_no_seeds(spark):
    rng = random.Random(5)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    docs = [(i, f"some words password={hexa(18)} more words of line {i}") for i in range(40)] + [(100 + i, f"here password=Zq{i}-hunter-{i}77 follows") for i in range(5)] + [(200 + i, f"under License, version {i}.0.12345678901 of it") for i in range(20)]
    rows = {r.doc_id: r for r in find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = dict(docs)
    assert all([texts[i][x.s : x.e] for x in rows[i].secret] == [re.search(r"password=(\S+)", texts[i])[1]] for i in [*range(40), *range(100, 105)])
    assert not any(rows[200 + i].secret for i in range(20))


def test_base_spans_are_seeds_of_contexts(spark):
    rng = random.Random(6)
    words = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnop"]
    some = lambda: " ".join(rng.choice(words) for _ in range(6))
    docs = [(i, f"{some()} phone: +1555{1000000 + i * 7} {some()}") for i in range(60)] + [(100 + i, f"{some()} contact=u{i}@ex{i % 9}.com {some()}") for i in range(60)]
    docs += [(200, f"{some()} phone: 123-45-6789 {some()}"), (201, f"{some()} phone: 98765432 {some()}"), (202, f"{some()} contact=alicesmith {some()}")]
    docs += [(300 + i, f"{some()} order 10{i}234567 {some()}") for i in range(20)]
    rows = {r.doc_id: r for r in find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = dict(docs)
    found = {i: [texts[i][x.s : x.e] for x in r.secret] for i, r in rows.items() if r.secret}
    assert found == {200: ["123-45-6789"], 201: ["98765432"], 202: ["alicesmith"]}
    assert all(len(rows[i].phone) == 1 for i in range(60)) and all(len(rows[100 + i].email) == 1 for i in range(60))


def test_query_names_kinds_and_hashes_base_spans(spark, tmp_path):
    from sparkcohort.llm.queries import op3_pii

    texts = {1: "\U0001f600 a@b.co 1.2.3.4 4111 1111 1111 1111 +1 234 567 890 then x.y@z.org", 2: None, 3: "no span"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op3_pii(spark, str(tmp_path)).collect():
        found = brute(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in found[k])
        assert (r.spans, r.base_sha256) == (listed, hashlib.sha256(listed.encode()).hexdigest())
        assert [r[f"n_{k}"] for k in KINDS] == [len(found[k]) for k in KINDS]
