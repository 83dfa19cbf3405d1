"""WARC archives: a writer and a sequential reader.

Every record is a gzip member of its own. Pages with equal payloads are written once, as the response of the
largest page_id; the others are revisit records that refer to it. The reader decompresses a file in chunks,
frames records by Content-Length and verifies each digest as the bytes pass, so neither side holds more than a
chunk and the headers of one record (the writer: one page).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.shared import cut, new_folder, small_batches, tidied

URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
#: Repeated digests that are broadcast at most, at 28 bytes each.
MOST_BROADCAST = 1_000_000
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, member_offset long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """A whole record as one gzip member."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"] if is_revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def mark_revisits(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, is_revisit.

    Who keeps a payload is decided on digests alone. Only digests seen twice are joined back to the payloads: by
    broadcast up to MOST_BROADCAST of them, so no payload is shuffled; beyond that Spark joins by shuffle and splits a
    hot digest's pages (adaptive skew join). Pages are never grouped by digest.
    """
    p = small_batches(pages).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload")))
    seen = p.filter(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    repeated = cut(seen.filter("n > 1 and keeper is not null").select(F.col("sha").alias("of_sha"), "keeper"), "warc-repeated")
    repeated = F.broadcast(repeated) if repeated.count() <= MOST_BROADCAST else repeated
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return p.join(repeated, F.col("sha") == F.col("of_sha"), "left").select("page_id", "url", "payload", F.when(revisit, F.col("keeper")).alias("refers_to"), revisit.alias("is_revisit"))


def write_archives(marked: DataFrame, folder: str, *, most_bytes: int = 1 << 30) -> DataFrame:
    """Write records below folder; returns the manifest (archive, n_records, n_bytes) of what finished tasks wrote.

    A file's name holds the task attempt: files of attempts that were lost are in no manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, files = None, []

        def start():
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(files):04d}.warc.gz"
            files.append([f"{folder}/{name}", 0, 0])
            return store.open_output_stream(f"{root}/{name}", compression=None)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or files[-1][2] >= most_bytes:
                    if out is not None:
                        out.close()
                    out = start()
                member = record(*row)
                out.write(member)
                files[-1][1] += 1
                files[-1][2] += len(member)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "n_records", "n_bytes"])

    return marked.mapInArrow(tidied(run), "archive string, n_records long, n_bytes long")


class Framer:
    """Records of one archive from chunks of compressed bytes."""

    def __init__(self, stream, name: str = "", with_payload: bool = False) -> None:
        self.stream, self.name, self.with_payload = stream, name, with_payload
        self.rest, self.member_at, self.read = b"", 0, 0

    def _member(self) -> Iterator[bytes]:
        """The decompressed chunks of the member at hand; what follows it stays in self.rest."""
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if unpack.unconsumed_tail:
                data = unpack.unconsumed_tail
            elif self.rest:
                data, self.rest = self.rest, b""
            else:
                data = self.stream.read(CHUNK)
                self.read += len(data)
                if not data:
                    raise ValueError(f"{self.name}: the member at {self.member_at} is cut short")
            if body := unpack.decompress(data, CHUNK):
                yield body
        self.rest = unpack.unused_data

    def _more(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(CHUNK)
            self.read += len(self.rest)
        return bool(self.rest)

    def __iter__(self) -> Iterator[dict]:
        while self._more():
            self.member_at = self.read - len(self.rest)
            chunks = self._member()
            head, body = self._until(chunks, b"")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"{self.name}: no record at {self.member_at}")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            left = int(fields["Content-Length"])
            http, body = self._until(chunks, body)
            block, payload, size, kept = hashlib.sha1(http + b"\r\n\r\n"), hashlib.sha1(), 0, []
            left -= len(http) + 4
            while left > 0:
                body = body or next(chunks, b"")
                if not body:
                    raise ValueError(f"{self.name}: the record at {self.member_at} is shorter than its Content-Length")
                part, body = body[:left], body[left:]
                left -= len(part)
                size += len(part)
                block.update(part)
                payload.update(part)
                if self.with_payload:
                    kept.append(part)
            end = body + b"".join(chunks)
            if left or end != b"\r\n\r\n":
                raise ValueError(f"{self.name}: the record at {self.member_at} does not end at its Content-Length")
            text = lambda x: base64.b32encode(x.digest()).decode()
            revisit = fields["WARC-Type"] == "revisit"
            if fields["WARC-Block-Digest"] != f"sha1:{text(block)}" or not revisit and fields["WARC-Payload-Digest"] != f"sha1:{text(payload)}":
                raise ValueError(f"{self.name}: a digest of the record at {self.member_at} differs")
            declared = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
            number = lambda x: int(x) if (x := x.strip("<>").removeprefix(URN)) else None
            yield {
                "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": declared if revisit else size,
                "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"],
                "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "archive": self.name, "member_offset": self.member_at,
            } | ({"payload": b"".join(kept)} if self.with_payload else {})

    def _until(self, chunks: Iterator[bytes], body: bytes, mark: bytes = b"\r\n\r\n") -> tuple[bytes, bytes]:
        while (at := body.find(mark)) < 0:
            more = next(chunks, b"")
            if not more or len(body) > 1 << 24:
                raise ValueError(f"{self.name}: the headers at {self.member_at} do not end")
            body += more
        return body[:at], body[at + len(mark) :]


def read_archives(archives: DataFrame, *, with_payload: bool = False, rows: int = 2000) -> DataFrame:
    """Records of the archives named in the column `archive`, one task for each file; with their payloads if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                got: list[dict] = []
                held = 0
                with store.open_input_stream(path, compression=None) as stream:
                    for one in Framer(stream, name, with_payload):
                        got.append(one)
                        held += len(one.get("payload", b""))
                        if len(got) >= rows or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(got, schema=kinds)
                            got, held = [], 0
                if got:
                    yield pa.RecordBatch.from_pylist(got, schema=kinds)

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("member_offset", pa.int64()), *([("payload", pa.binary())] if with_payload else [])])
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(tidied(run), RECORD_SCHEMA + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write all pages as WARC archives and read them back.

    Null html is an empty payload; a null url an empty one. Of equal payloads the largest page_id is the response
    (rows that repeat that page_id too); rows with a null page_id revisit it, or are responses if no page of that
    payload has an id. An empty table gives no archive and no rows; other columns are not read.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    manifest = cut(write_archives(mark_revisits(pages, page_id=page_id, url=url, html=html, least_bytes=least_bytes), folder), "warc-manifest")
    return read_archives(manifest, with_payload=with_payload)
