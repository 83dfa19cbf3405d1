import gzip
import hashlib
import io

import pytest

from sparkcohort.llm.warc import Framer, base32_sha1, record, round_trip

PAGES = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/ü?\n", ""), (5, "u", "é" * 300_000), (6, "u", "é" * 300_000),
    (7, "u", "only"), (None, "u", "only"), (None, "u", "no id"), (8, "u", "twice"), (8, "u", "twice"), (9, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, payload string, sha string")


def test_round_trip(spark, tmp_path):
    got = round_trip(frame(spark, PAGES), folder=f"file://{tmp_path}/w", with_payload=True).collect()
    assert len(got) == len(PAGES)
    best = {}
    for i, _, h in PAGES:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        keeper = best.get(h or "")
        revisit = keeper is not None and i != keeper
        want.append((i, len(body), base32_sha1(body), "revisit" if revisit else "response", keeper if revisit else None, b"" if revisit else body))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload))) for r in got)


def test_least_bytes_and_empty(spark):
    rows = round_trip(frame(spark, PAGES), least_bytes=100).collect()
    assert {r.page_id for r in rows if r.record_type == "revisit"} == {5}
    assert round_trip(frame(spark, PAGES[:0])).count() == 0


def test_every_member_is_a_record_and_damage_is_seen():
    a, b = record(1, "u", b"abc" * 1000, None, False), record(2, "u", b"abc" * 1000, 1, True)
    assert gzip.decompress(a).startswith(b"WARC/1.1") and len(list(Framer(io.BytesIO(a + b)))) == 2
    got = list(Framer(io.BytesIO(a + b), with_payload=True))
    assert got[0]["payload"] == b"abc" * 1000 and got[1]["payload_bytes"] == 3000 and got[1]["refers_to"] == 1
    assert hashlib.sha1(got[0]["payload"]).digest()
    with pytest.raises(ValueError, match="cut short"):
        list(Framer(io.BytesIO((a + b)[:-9])))
    plain = gzip.decompress(a)
    with pytest.raises(ValueError, match="digest"):
        list(Framer(io.BytesIO(gzip.compress(plain.replace(b"abcabc", b"abdabc", 1)))))
    with pytest.raises(ValueError, match="Content-Length"):
        list(Framer(io.BytesIO(gzip.compress(plain[:-6]))))
