import hashlib

import pytest
from pyspark.sql import functions as F

from factspark.llm.warc import archive_rows, header, parsed, plan_records, read_archive, record_bytes


def pages(spark):
    long = "é" * 1000
    rows = [(1, "u1", long, 0), (2, "u2", long, 0), (3, None, "short", 0), (4, "u\r\n4", "short", 0), (5, "u5", None, 0), (6, "u6", "", 0), (7, "u7", "x" * 1000, 0), (8, "u8", "x" * 999, 0), (9, "u9", "x" * 999, 0), (10, "u10", "z" * 300_000, 0), (10, "u10", "z" * 300_000, 0), (None, "n", "q", 0)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")


def test_records_read_back(spark):
    rows, d = pages(spark)
    archive = archive_rows(plan_records(d), chunk=700)
    assert archive.agg(F.max(F.octet_length("data"))).first()[0] <= 700
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archive(archive).collect()}
    body = lambda h: (h or "").encode()
    want = {(i, len(body(h)), hashlib.sha1(body(h)).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h, _ in rows}
    assert got == want and read_archive(archive).count() == len(rows)


def test_a_record_is_a_warc_record(spark):
    _, d = pages(spark)
    data = record_bytes(archive_rows(plan_records(d), chunk=700).where("record_id = 2").collect())
    head, _, rest = data.partition(b"\r\n\r\n")
    length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))[16:])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and rest[length:] == b"\r\n\r\n" and rest[:length].endswith("é".encode())


def test_damage_is_seen(spark):
    _, d = pages(spark)
    archive = archive_rows(plan_records(d), chunk=700)
    for bad in (archive.where("not (record_id = 7 and chunk = 1)"), archive.withColumn("data", F.when(F.col("record_id") == 3, F.lit("shorT").cast("binary")).otherwise(F.col("data")))):
        with pytest.raises(Exception, match="damaged|lacks"):
            read_archive(bad).collect()


def test_records_come_from_their_headers(spark):
    for url, back in (("http://a/ b: c", "http://a/ b: c"), (None, None), ("", ""), ("a\r\nWARC-Type: x", "a%0D%0AWARC-Type: x")):
        assert parsed(header("revisit", 3, url, "ab", 9, 4))[1] == (3, 9, "ab", "revisit", 4, back)
    _, d = pages(spark)
    archive = archive_rows(plan_records(d), chunk=700)
    cut = lambda old, new: archive.withColumn("header", F.when(F.col("record_id") == 7, F.replace("header", F.lit(old), F.lit(new))).otherwise(F.col("header")))
    for old, new in (("Content-Length: 1", "Content-Length: 2"), ("WARC/1.1", "WARC/9"), ("urn:page:7", "urn:page:8"), ("sha1:", "sha1:0")):
        with pytest.raises(Exception, match="damaged"):
            read_archive(cut(old, new)).collect()
    assert {r.refers_to for r in read_archive(cut("response\r\nWARC-Record", "revisit\r\nWARC-Refers-To: <urn:page:1>\r\nWARC-Record")).where("page_id = 7").collect()} == {1}


def test_every_record_has_a_date(spark):
    _, d = pages(spark)
    heads = [r.header for r in archive_rows(plan_records(d), date="2024-05-06T07:08:09Z").where("chunk = 0").collect()]
    assert heads and all("\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n" in h for h in heads)
    assert len({parsed(r.header)[0] and r.header.split("WARC-Date: ")[1][:20] for r in archive_rows(plan_records(d)).where("chunk = 0").collect()}) == 1
    for bad in ("", "2024-05-06", "yesterday"):
        with pytest.raises(ValueError, match="date"):
            parsed(header("response", 1, "u", "ab", 9, None, bad))


def test_copies_with_other_urls_keep_them(spark):
    d = spark.createDataFrame([(1, "a", "q"), (1, "b", "q"), (1, "b", "q"), (None, "c", None), (None, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.url or "") for r in read_archive(archive_rows(plan_records(d))).collect()) == [(0, ""), (0, "c"), (1, "a"), (1, "b"), (1, "b")]


def test_empty(spark):
    _, d = pages(spark)
    assert read_archive(archive_rows(plan_records(d.limit(0)))).count() == 0
