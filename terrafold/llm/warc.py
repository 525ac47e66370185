"""Deduplicated web archives: revisit records point at the response with their payload.

Only headers (id, digest, size) are shuffled by digest. Digests that occur once
need no join; for the others the largest id is the original, counted with
partial aggregation, so a payload shared by a third of all records makes no hot
task. The list of revisits is then joined to the records by id and digest,
which is nearly unique.

Archives are plain WARC 1.1 files written by Spark's text writer, a record per
"line" whose separator is the blank lines that end a WARC record. Every record
begins with a ``WARC-Warcinfo-ID`` that is random per archive and unknown to any
payload, and reading splits there, so large files are read in parallel.

Defined cases: a null payload is empty; a null url gives no target; line breaks
in urls are percent-encoded; repeated rows (same id and payload) get the same
type; records without id are responses; no rows give an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.session import materialize, scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: 32 digits of five bits."""
    digits = F.sha1(payload)

    def digit(i: int) -> Column:
        five_hex = F.conv(F.substring(digits, 5 * (i // 4) + 1, 5), 16, 10).cast("int")
        value = F.shiftright(five_hex, 15 - 5 * (i % 4)).bitwiseAND(F.lit(31))
        return F.substring(F.lit(BASE32), value + 1, F.lit(1))

    return F.concat(*(digit(i) for i in range(32)))


def with_payload(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Records (record, url, body, bytes, digest) from a page table."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(F.col(key).cast("long").alias("record"), F.col(url).alias("url"), body.alias("body")).select(
        "*", F.octet_length("body").cast("long").alias("bytes"), sha1_base32(F.col("body").cast("binary")).alias("digest")
    )


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Revisits as (record, digest, original), one row each; all other records are responses."""
    headers = records.where(F.col("bytes") >= min_bytes).select("record", "digest")
    repeated = materialize(
        headers.groupBy("digest").agg(F.max("record").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "originals",
    )
    return headers.join(repeated, "digest").where("record < original").distinct()


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> str:
    """Write the records under ``path`` and return the archive's folder."""
    archive = str(uuid.uuid4())
    revisits = materialize(resolve_revisits(records, min_bytes), "revisits")
    typed = records.join(revisits, ["record", "digest"], "left")
    is_revisit = F.col("original").isNotNull()
    body = F.when(is_revisit, "").otherwise(F.col("body"))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))  # null, so left out, without a value

    urn = lambda c: F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat_ws(
        "",
        F.lit(marker(archive)),
        header("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", urn(F.col("record"))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", uri),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        header("WARC-Refers-To", urn(F.col("original"))),
        header("WARC-Profile", F.when(is_revisit, REVISIT_PROFILE)),
        header("Payload-Length", F.col("bytes").cast("string")),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF),
        body,
    )
    folder = f"{path.rstrip('/')}/{archive}.warc"
    typed.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).text(folder)
    return folder


def marker(archive: str) -> str:
    """First two lines of every record of an archive."""
    return f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <urn:uuid:{archive}>{CRLF}"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of an archive written by :func:`write_archives`.

    ``payload`` holds the bytes announced by Content-Length, and ``intact`` says
    whether a response's payload has the digest its header names.
    """
    archive = folder.rstrip("/").rsplit("/", 1)[-1].removesuffix(".warc")
    chunks = spark.read.option("lineSep", marker(archive)).text(folder).where("value <> ''")
    split = chunks.select("value", F.substring_index("value", CRLF + CRLF, 1).alias("head"))
    parsed = split.select(
        "value", "head", F.str_to_map("head", F.lit(CRLF), F.lit(": ")).alias("h")
    )
    length = F.col("h")["Content-Length"].cast("int")
    parsed = parsed.select(
        "h", F.substring(F.col("value").cast("binary"), F.octet_length("head") + 5, length).alias("payload")
    )
    number = lambda c: F.regexp_extract(c, "<urn:record:(-?[0-9]+)>", 1).try_cast("long")
    digest = F.substring(F.col("h")["WARC-Payload-Digest"], 6, 32)
    return parsed.select(
        number(F.col("h")["WARC-Record-ID"]).alias("record"),
        F.col("h")["WARC-Target-URI"].alias("url"),
        F.col("h")["WARC-Type"].alias("record_type"),
        digest.alias("digest"),
        number(F.col("h")["WARC-Refers-To"]).alias("refers_to"),
        F.col("h")["Payload-Length"].cast("long").alias("bytes"),
        "payload",
        ((F.col("h")["WARC-Type"] == "revisit") | (sha1_base32(F.col("payload")) == digest)).alias("intact"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write a page table as deduplicated archives and read them back."""
    spark = pages.sparkSession
    folder = write_archives(with_payload(pages), path or scratch_path(spark, "archives"))
    return read_archives(spark, folder)
