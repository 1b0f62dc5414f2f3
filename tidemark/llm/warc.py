"""A content-addressed WARC archive as two tables.

``payloads``: every payload's bytes once, addressed by SHA-256. ``headers``: the exact
header bytes of every record, with the address. A record is put together again by a join;
on the way back the digest is computed anew from the stored bytes and compared with
the address, so a damaged payload fails the read instead of passing unnoticed.

Of records with equal payloads of ``LEAST`` bytes or more, that with the largest page_id is
a response; the others are revisits that refer to it and carry no payload of their own.
Shorter payloads always make responses; they are stored once all the same.

Defined results: null html counts as empty, a null url as an empty target, line ends in a
url are percent-encoded; a null page_id counts as smallest. Rows repeated in page_id and
payload are all written, and if that page_id is the largest all are responses. An empty
table gives an archive without records. Extra columns are left out. Everything runs on
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, scratch_path, store

LEAST = 1000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def described(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digests and length; no shuffle."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumns(
        {"address": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload"), "length": F.octet_length("payload").cast("long")}
    )


def header(kind: Column, page: Column, url: Column, sha1: Column, length: Column, refers_to: Column) -> Column:
    """The header block of a record, up to and including the empty line."""
    revisit = kind == "revisit"
    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _id(page)),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.concat(F.lit("X-Payload-Length: "), length.cast("string")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id(refers_to))),
        F.when(~revisit, F.lit("Content-Type: text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(length.cast("string"))),
    )
    return F.concat(lines, F.lit(CRLF * 2)).cast("binary")


def with_keeper(narrow: DataFrame, keeper: DataFrame) -> DataFrame:
    """``narrow`` rows with the keeper of their address, of a stored table."""
    return narrow.join(keeper.hint("merge"), "address")


def write_archive(pages: DataFrame, path: str) -> None:
    """Write ``pages`` as an archive under ``path`` (folders ``headers`` and ``payloads``).

    The keeper of every address is settled on narrow rows, aggregated before the shuffle,
    stored and only then joined back by sorted sides: with nothing but shuffles below the
    join, AQE splits it where one address is hot. Copies of one payload meet in their own task first, so at most
    one of them per task is shuffled.
    """
    rows = described(pages)
    narrow = rows.drop("payload")
    keeper = store(narrow.groupBy("address").agg(F.max("page_id").alias("keeper")), "keepers")
    joined = with_keeper(narrow, keeper)
    first = F.col("page_id").eqNullSafe(F.col("keeper"))
    kind = F.when((F.col("length") >= LEAST) & ~first, F.lit("revisit")).otherwise(F.lit("response"))
    head = header(kind, F.col("page_id"), F.col("url"), F.col("sha1"), F.col("length"), F.col("keeper"))
    joined.select("page_id", head.alias("header"), "address").write.option("compression", "zstd").parquet(f"{path}/headers")
    drop(keeper)
    once = rows.groupBy("address").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: page_id, header, payload (of a revisit: that of the record it refers
    to). Fails on a payload that doesn't match its address."""
    headers = spark.read.schema("page_id bigint, header binary, address binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("address binary, payload binary").parquet(f"{path}/payloads")
    checked = payloads.withColumn(
        "payload",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("address"))).cast("binary")),
    )
    return headers.join(checked, "address").select("page_id", "header", "payload")


def field(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def parsed(records: DataFrame) -> DataFrame:
    """Records with what their headers say and what their payloads are."""
    number = r"<urn:page:(-?\d+)>"
    return records.select(
        "page_id",
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Refers-To"), number, 1).try_cast("bigint").alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field("WARC-Payload-Digest").alias("said"),
        "header",
        "payload",
    )


def records(archive: DataFrame, *more: str) -> DataFrame:
    """The exact bytes of every record: header, its own payload (none in revisits), end;
    and ``more`` columns of ``archive``."""
    own = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return archive.select("page_id", F.concat("header", own, F.lit(CRLF * 2).cast("binary")).alias("record"), *more)


def rebuilt(archive: DataFrame) -> DataFrame:
    """``archive`` put together to records and taken apart again: the header is what stands
    before the first empty line, the payload of a response what stands between that line
    and the record's end; a revisit has the payload of the record that it refers to."""
    end = CRLF * 2
    whole = records(archive, "payload")
    head = F.substring_index(F.col("record").cast("string"), end, 1)
    size = F.octet_length(head) + len(end)
    own = F.substring("record", size + 1, F.octet_length("record") - size - len(end))
    parts = whole.select("page_id", F.concat(head, F.lit(end)).cast("binary").alias("header"), own.alias("own"), "payload")
    return parts.withColumn("payload", F.when(field("WARC-Type") == "response", F.col("own")).otherwise(F.col("payload"))).drop("own")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder, rebuild the records and describe them."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    back = parsed(rebuilt(read_archive(spark, path)))
    right = F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("said")
    digest = F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload and header disagree")).cast("string"))
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE = f"""
WITH rows AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM rows)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= {LEAST} AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND page_id <> keeper THEN keeper END AS refers_to
FROM best
"""
