"""WARC archives: written with one gzip member per record, read sequentially.

Archives are binary segments of bounded size, each a whole number of gzip members; the concatenated segments of an
archive are a .warc.gz file, and a file read with Spark's binaryFile source is one segment. The reader decompresses
incrementally, frames records by their content length and checks digests; it holds one record at a time.

Equal payloads are stored once: the record with the smallest id is the response, the others are revisits that keep the
HTTP headers, and with them the length of the full payload, but not the payload.

Defined cases: a null payload is an empty one; a null url gets a URN of the id; a page without id is always a response;
a repeated row equals its first record and is a response too; an empty table gives an empty table; extra columns are
ignored; payloads of any length are written whole.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import materialize

DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT_BYTES = 8 << 20
_CHUNK = 1 << 16


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not compressed: a response with its payload, or a revisit without."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    name = "" if page_id is None else page_id
    target = (url or f"urn:page:{name}").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _members(segment: memoryview) -> Iterator[Iterator[bytes]]:
    """The decompressed chunks of each gzip member in turn; a member must be used up before the next."""
    at = 0

    def chunks() -> Iterator[bytes]:
        nonlocal at
        d = zlib.decompressobj(31)
        while not d.eof:
            if at >= len(segment):
                raise ValueError("the last gzip member is cut off")
            piece = segment[at : at + _CHUNK]
            at += len(piece)
            out = d.decompress(piece, _CHUNK * 4)
            while out or d.unconsumed_tail:
                yield out
                out = d.decompress(d.unconsumed_tail, _CHUNK * 4) if d.unconsumed_tail else b""
        at -= len(d.unused_data)

    while at < len(segment):
        yield chunks()


def read_records(segment) -> Iterator[dict]:
    """Records in order: the WARC headers by lower-case name, ``block`` bytes, and verified digests."""
    for chunks in _members(memoryview(segment)):
        buffer = bytearray()
        more = iter(chunks)
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            buffer += next(more, None) or _cut()
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        record: dict = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        length = int(record["content-length"])
        del buffer[: end + 4]
        while len(buffer) < length + 4:
            buffer += next(more, None) or _cut()
        if bytes(buffer[length : length + 4]) != b"\r\n\r\n" or len(buffer) > length + 4 or next(more, b""):
            raise ValueError("the record does not end where its content length says")
        record["block"] = bytes(buffer[:length])
        if (want := record.get("warc-block-digest")) and want != f"sha1:{sha1(record['block'])}":
            raise ValueError(f"block digest of {record.get('warc-record-id')} does not match")
        yield record


def _cut() -> bytes:
    raise ValueError("the record is cut off")


def page_of(record: dict) -> tuple[int | None, int, str, str, int | None]:
    """page_id, full payload's length and digest, type, and the id that it refers to. A response's digest is verified."""
    head, _, payload = record["block"].partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    number = lambda urn: int(n) if (n := urn.strip("<>").rpartition(":")[2]) else None
    kind, digest = record["warc-type"], record["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"])
    if kind == "response" and (len(payload) != size or sha1(payload) != digest):
        raise ValueError(f"payload of {record['warc-record-id']} does not match its digest")
    return number(record["warc-record-id"]), size, digest, kind, number(record["warc-refers-to"]) if kind == "revisit" else None


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and ``first``: the smallest id among equal payloads, null where a page is not a revisit.

    Only ids and digests of payloads that repeat are joined back. That table is written first: the join then stands on
    plain shuffles, which adaptive execution splits when one payload is very frequent, or broadcasts it if it is small.
    """
    hashed = pages.withColumn("digest", F.sha1(F.col("payload")))
    seen = hashed.where((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("least"), F.max("page_id").alias("most"))
    repeated = materialize(seen.where("least < most").select(F.col("digest").alias("d"), "least"), "warc-repeats")
    return hashed.join(repeated, F.col("digest") == F.col("d"), "left").select("page_id", "url", "payload", F.when(F.col("page_id") > F.col("least"), F.col("least")).alias("first"))


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write a record per row; returns the written table of segments (content)."""
    source = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = bytearray()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([bytes(segment)], pa.binary())], names=["content"])
            segment.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                page, target, payload, first = (batch.column(c)[i].as_py() for c in range(4))
                segment += gzip_member(record_bytes(page, target, payload, sha1(payload), first), level)
                if len(segment) >= SEGMENT_BYTES:
                    yield out()
        if segment:
            yield out()

    return materialize(with_first(source, min_bytes).mapInArrow(run, "content binary"), "warc")


def read_archives(segments: DataFrame) -> DataFrame:
    """One row per record of the segments in the binary column ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for content in batch.column("content"):
                rows = [page_of(r) for r in read_records(content.as_buffer())]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return segments.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages))
