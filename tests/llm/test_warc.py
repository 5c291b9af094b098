import base64
import hashlib
import re

import pytest

from puckline.llm import warc
from puckline.session import shared_dir

SCHEMA = "page_id long, url string, html string, header string, digest string"
PAGES = [(1, "http://a/", "x", "h", "d"), (2, "http://b/", "x", "h", "d"), (3, None, "", "h", "d"), (4, "u\r\nEvil: 1", None, "h", "d"),
         (5, "u", "é" * 100_000, None, None), (2, "http://b/", "x", "h", "d"), (None, "n", "lone", "h", "d"), (None, "n", "x", "h", "d"),
         (7, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n", "h", "d")]


def expected(pages, least=0):
    out = []
    for page, _, html, *_ in pages:
        payload = (html or "").encode()
        key = -(2**63) if page is None else page
        best = max(-(2**63) if p is None else p for p, _, h, *_ in pages if (h or "").encode() == payload)
        response = len(payload) < least or key == best
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if response else "revisit", None if response else best))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 2])
def test_records(spark, least):
    got = warc.archive_pages(spark.createDataFrame(PAGES, SCHEMA), least)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(PAGES, least)


def test_payloads_are_stored_once_and_records_restored(spark):
    path = shared_dir(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(PAGES, SCHEMA), path)
    _, payloads = warc.read_archive(spark, path)
    assert payloads.count() == len({(h or "") for _, _, h, *_ in PAGES})
    records = warc.restore_records(spark, path).collect()
    assert len(records) == len(PAGES)
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        body = rest[:int(fields["Content-Length"])]
        assert rest[len(body):] == b"\r\n\r\n"
        assert body == (bytes(r.payload) if fields["WARC-Type"] == "response" else b"")
        assert "Evil" not in fields
        digest = base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        assert fields["WARC-Payload-Digest"] == f"sha1:{digest}"
    by_id = {r.page_id: bytes(r.payload).decode() for r in records if r.page_id is not None}
    assert by_id == {p: h or "" for p, _, h, *_ in PAGES if p is not None}


def test_a_changed_payload_is_noticed(spark):
    from pyspark.sql import functions as F

    path = shared_dir(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(PAGES, SCHEMA), path)
    _, payloads = warc.read_archive(spark, path)
    other = shared_dir(spark, "warc-test")
    payloads.withColumn("payload", F.lit("?").cast("binary")).write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="does not match digest"):
        warc.read_records(spark, other).collect()


def test_headers_name_the_payload_read(spark):
    path = shared_dir(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(PAGES, SCHEMA), path)
    rows = warc.read_records(spark, path).collect()
    assert all(r.header_digest == r.payload_digest and re.fullmatch("[A-Z2-7]{32}", r.header_digest) for r in rows)


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_urls_that_look_like_headers(spark):
    url = "http://x/?WARC-Type: response"
    rows = [(1, url, "same"), (2, f"{url}\r\nWARC-Type: response\r\n", "same"), (3, "WARC/1.1 WARC-Type: revisit", "other")]
    path = shared_dir(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, date="2024-05-06T07:08:09Z")
    for r in warc.restore_records(spark, path).collect():
        header, _, body = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: ([0-9]+)", header)[1])
        assert header.count(b"\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n") == 1
        assert body == (b"" if r.page_id == 1 else bytes(r.payload)) + b"\r\n\r\n" and length == len(body) - 4
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.read_records(spark, path).collect()} == {
        (1, "revisit", 2), (2, "response", None), (3, "response", None)}
