"""WARC as a table of record chunks: a payload of any size is a run of (record id, chunk number) rows with incremental digests."""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shuffle_parts, staged

CHUNK = 64 * 1024
#: Bytes that a batch of chunk rows holds before it is handed on.
BATCH = 4 * 1024 * 1024
#: Payloads that occur more than once, by digest, are broadcast up to so many; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
ARCHIVE = "record_id long, url string, record_type string, refers_to long, header string, payload_bytes long, payload_digest string, chunk int, last boolean, data binary, running_digest string"
_DATE = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def header(record_type: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> str:
    """The WARC/1.1 named fields of a record; line breaks in a URL are percent-encoded."""
    length = len(_HTTP) + (size if record_type == "response" else 0)
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    target = [] if url is None else [f"WARC-Target-URI: {uri}"]
    fields = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", *target, f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    if record_type == "revisit":
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(fields) + "\r\n\r\n"


def parsed(text: str) -> tuple[int, tuple]:
    """(Content-Length, (page_id, payload_bytes, payload_digest, record_type, refers_to, url)) of a record's header; an absent
    URL is null. ValueError for what isn't such a header."""
    version, *lines = text.split("\r\n")
    if version != "WARC/1.1" or lines[-2:] != ["", ""]:
        raise ValueError(f"damaged header: {text[:80]!r}")
    named = dict(x.split(": ", 1) for x in lines[:-2])
    if not _DATE.fullmatch(named.get("WARC-Date", "")):
        raise ValueError(f"a record without a date: {text[:80]!r}")
    page = lambda urn: None if urn in (None, "<urn:page:None>") else int(urn.removeprefix("<urn:page:").removesuffix(">"))
    record = (page(named["WARC-Record-ID"]), int(named["X-Payload-Length"]), named["WARC-Payload-Digest"].removeprefix("sha1:"), named["WARC-Type"], page(named.get("WARC-Refers-To")), named.get("WARC-Target-URI"))
    return int(named["Content-Length"]), record


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, digest, size, first: the largest page_id among payloads equal to this one of at least `least` bytes, else null.

    Equal payloads meet by digest and size in an aggregate with map-side sums, never as a group of rows.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    seen = p.where(F.col("size") >= least).groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    twice = staged(seen.where("n > 1").drop("n"), "equal-payloads")
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    return p.join(twice, (p["digest"] == twice["d"]) & (p["size"] == twice["s"]), "left").drop("d", "s")


def archive_rows(records: DataFrame, chunk: int = CHUNK, date: str | None = None) -> DataFrame:
    """The chunk rows of planned records. A revisit is one row without data. All records bear one date (UTC, to the second), without
    one given that of the call, so a task that is run again writes the same bytes."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        out, held = [], 0
        for b in batches:
            texts = b.column(2)
            for i, (page, url, digest, size, first) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True)):
                revisit = first is not None and first != page
                kind, at = "revisit" if revisit else "response", 0
                head = header(kind, page, url, digest, size, first if revisit else None, date)
                data = memoryview(texts[i].as_buffer()) if texts[i].is_valid and not revisit else memoryview(b"")
                sha = hashlib.sha1()
                while True:
                    part = data[at * chunk : (at + 1) * chunk]
                    sha.update(part)
                    last = (at + 1) * chunk >= len(data)
                    out.append((page, url, kind, first if revisit else None, head if not at else None, size, digest, at, last, bytes(part), digest if revisit else sha.hexdigest()))
                    held += len(part) + 500
                    at += 1
                    if held >= BATCH:
                        yield _chunks(out)
                        out, held = [], 0
                    if last:
                        break
        if out:
            yield _chunks(out)

    return records.select("page_id", "url", "html", "digest", "size", "first").mapInArrow(run, ARCHIVE)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
_NAMES = [x.split()[0] for x in ARCHIVE.split(", ")]


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def read_archive(archive: DataFrame) -> DataFrame:
    """A row per record, read from its header and chunks: page_id, payload_bytes, payload_digest, record_type, refers_to, url (as it
    stands in the header, line breaks percent-encoded).

    Chunks are streamed in order; every running digest, the content length and the payload digest are checked. A record whose
    header or chunks are missing or damaged raises ValueError. Records alike in all of these columns are told apart by how often
    their chunks come.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    key = ["record_id", "payload_digest", "record_type", "url"]
    # copies of one record, sorted by chunk, mix, which equal data survive
    rows = archive.repartition(max(1, shuffle_parts(archive.sparkSession)), F.xxhash64(*key)).sortWithinPartitions(*key, "chunk")

    def run(batches):
        now, head, at, times, whole, size, sha = None, None, -1, 0, False, 0, None
        out = []

        def close():
            if now is None:
                return
            length, record = parsed(head)
            intact = record[3] == "revisit" or (size, sha.hexdigest()) == record[1:3]
            if not whole or not intact or length != len(_HTTP) + size or record[0] != now[0]:
                raise ValueError(f"record {now[0]} is damaged")
            out.extend([record] * times)

        for b in batches:
            d = dict(zip(b.schema.names, b.columns, strict=True))
            data = d["data"]
            for i, (*record, chunk, last, running, text) in enumerate(zip(*(d[k].to_pylist() for k in (*key, "chunk", "last", "running_digest", "header")), strict=True)):
                if record != now:
                    close()
                    now, head, at, times, whole, size, sha = record, text, -1, 0, False, 0, hashlib.sha1()
                if chunk == 0:
                    times += 1
                    if text is None or text != head:
                        raise ValueError(f"record {now[0]} has a damaged header")
                if chunk == at:
                    continue
                if chunk != at + 1:
                    raise ValueError(f"record {now[0]} lacks chunk {at + 1}")
                part = data[i].as_buffer()
                sha.update(part)
                at, whole, size = chunk, last, size + len(part)
                if now[2] == "response" and sha.hexdigest() != running:
                    raise ValueError(f"record {now[0]} is damaged in chunk {chunk}")
            if out:
                yield _records(out)
                out.clear()
        close()
        if out:
            yield _records(out)

    return rows.mapInArrow(run, schema)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def record_bytes(rows: list) -> bytes:
    """One record of an archive, from its chunk rows, as it stands in a .warc file."""
    rows = sorted(rows, key=lambda r: r["chunk"])
    return (rows[0]["header"] + _HTTP).encode() + b"".join(bytes(r["data"]) for r in rows) + b"\r\n\r\n"


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = staged(archive_rows(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))), "warc")
    return read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to FROM r
"""
