"""Operator 5, WARC: content-addressed archive.

An archive is two tables in one folder.  ``payloads`` holds each distinct
payload once, under its SHA-256 digest.  ``headers`` holds, for every page,
the exact header block of its WARC record and the digest of its payload.  A
record is the header block followed by the payload (a revisit record has no
payload of its own); ``restore_records`` rebuilds the bytes by joining the two
tables and checks every payload against both digests.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from puckline.session import shared_dir

SALTS = 32
CRLF = "\r\n"
# The base-32 alphabet of RFC 4648 and the digits of base 32 in F.conv.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a null page_id when the largest one of a group is taken.
NO_ID = -(2**63)


def sha1_base32(payload: Column) -> Column:
    """SHA-1 of a binary column as 32 base-32 characters: eight pieces of 20 bits."""
    digest = F.sha1(payload)
    pieces = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*pieces), CONV32, BASE32)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.when(page_id != NO_ID, page_id.cast("string")).otherwise("none"), F.lit(">"))


def _one_line(text: Column) -> Column:
    """A header value must not hold line ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def _responders(keyed: DataFrame) -> DataFrame:
    """Digest -> largest page_id, repeated for each salt: a digest that many
    pages share is aggregated before the shuffle and joined in slices."""
    return (keyed.groupBy("digest").agg(F.max("page_key").alias("first_key"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None) -> None:
    """Archive every row of ``pages`` (page_id, url, html) under ``path``;
    ``date`` is every record's WARC-Date (by default the time of the call).

    The payload is the html in UTF-8; a null html is an empty payload.  Of
    records with equal payloads of at least ``min_bytes`` bytes, the one with
    the largest page_id is a response and the others are revisits that refer
    to it; smaller payloads are all responses.  A null page_id counts as the
    smallest id; repeated rows of the responding page_id are all responses
    (their payload is still stored once).  A null url is an empty target.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_key"),
        _one_line(F.col("url")).alias("url"), payload.alias("payload")).select(
        "page_key", "url", F.sha2("payload", 256).alias("digest"), sha1_base32(F.col("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("length"), "payload")
    narrow = (keyed.drop("payload")
              .withColumn("salt", F.pmod(F.xxhash64("page_key", "url"), F.lit(SALTS)).cast("int")))
    typed = narrow.join(_responders(narrow), ["digest", "salt"]).withColumn(
        "is_response", (F.col("length") < min_bytes) | (F.col("page_key") == F.col("first_key")))
    block_length = F.when(F.col("is_response"), F.col("length")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("is_response"), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_key"))),
        F.lit(f"WARC-Date: {date or _dt.datetime.now(_dt.timezone.utc).strftime('%Y-%m-%dT%H:%M:%SZ')}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(~F.col("is_response"), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_key")))),
        F.when(~F.col("is_response"), F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.concat(F.lit("Content-Length: "), block_length.cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))
    typed.select(
        F.when(F.col("page_key") != NO_ID, F.col("page_key")).alias("page_id"),
        header.cast("binary").alias("header"), "digest").write.parquet(f"{path}/headers")
    # One row per digest: the responder's, found among narrow rows, fetches its payload by id and digest.
    holders = narrow.groupBy("digest").agg(F.max("page_key").alias("page_key"))
    wide = keyed.select("digest", "page_key", "payload").join(holders, ["digest", "page_key"])
    wide.dropDuplicates(["digest", "page_key"]).select("digest", "payload").write.option(
        "compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.schema("page_id long, header binary, digest string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    return headers, payloads


def _checked(digest: Column, payload: Column) -> Column:
    """The payload, or an error that names the digest it does not have."""
    return F.when(F.sha2(payload, 256) == digest, payload).otherwise(
        F.raise_error(F.concat(F.lit("archive: payload does not match digest "), digest)).cast("binary"))


def restore_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record, payload): the bytes of every WARC record, header block
    and content, followed by two line ends, and the full payload it stands for."""
    headers, payloads = read_archive(spark, path)
    joined = headers.join(payloads, "digest").withColumn("payload", _checked(F.col("digest"), F.col("payload")))
    # The type is the second line of every header block; a URL may hold the same words.
    is_response = F.col("header").cast("string").startswith(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}")
    body = F.when(is_response, F.col("payload")).otherwise(F.lit("").cast("binary"))
    return joined.select("page_id", F.concat("header", body, F.lit(CRLF + CRLF).cast("binary")).alias("record"), "payload")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived record, from the stored bytes: page_id,
    payload_bytes, payload_digest (recomputed from the payload, after the
    payload was checked against its address), record_type, refers_to and
    header_digest (the digest that the header names)."""
    headers, payloads = read_archive(spark, path)
    checked = payloads.withColumn("payload", _checked(F.col("digest"), F.col("payload")))
    facts = (checked.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
                            sha1_base32(F.col("payload")).alias("payload_digest"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    text = F.col("header").cast("string")

    def field(name: str, pattern: str) -> Column:
        return F.regexp_extract(text, rf"\r\n{name}: {pattern}\r\n", 1)

    parsed = headers.select(
        "page_id", "digest", F.pmod(F.xxhash64("page_id", "header"), F.lit(SALTS)).cast("int").alias("salt"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("header_digest"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+|none)>").alias("refers"))
    return parsed.join(facts, ["digest", "salt"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(nullif(refers, '') AS BIGINT)").alias("refers_to"), "header_digest")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archive of ``pages`` to a fresh shared folder and read it back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archive(pages, path, min_bytes)
    return read_records(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, html FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM h
)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)
         FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM r
"""
