"""WARC records as a content-addressed archive.

`write_archive` stores every distinct payload once under its SHA-256 and the exact header block of every record
apart from it, in two Parquet tables below one path: `payloads` (digest, payload) and `records` (header,
record_type, payload_digest). `read_archive` checks every stored payload against its digest, joins the two and
gives back whole records; nothing but these tables is read.

A digest is never trusted alone: payloads that share one are grouped by their bytes, and two different ones stop the
write. Payloads whose digest is unique go from the scan to the store without a shuffle; repeated ones are combined
on the map side first, so a payload that a third of the records share moves once per task.

Of records with equal payloads of at least `least` bytes the one with the smallest id is the response, the others are
revisits that refer to it and have an empty block. Shorter payloads, the empty one among them, are always responses.
A null body is the empty payload, a null URL leaves out its header line, control characters and spaces in a URL are
percent-encoded. A null id loses to every other id; where all ids of a payload are null, and where rows repeat both id
and payload, each of these rows is a response. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from .common import BROADCAST_ROWS, repeated_keys, small, text_of

CRLF = "\r\n"
#: Profile of a revisit whose payload was stored before, as the WARC 1.1 standard names it.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))


def clean_url(url: Column) -> Column:
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def header_block(kind: Column, record_id: Column, url: Column, digest: Column, refers_to: Column, length: Column,
                 date: str) -> Column:
    """The header of a record up to and including the empty line; null lines are left out."""
    revisit = kind == "revisit"
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind),
             F.concat(F.lit("WARC-Record-ID: "), record_uri(record_id)), F.lit(f"WARC-Date: {date}"),
             F.concat(F.lit("WARC-Target-URI: "), clean_url(url)),
             F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
             F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_uri(refers_to))),
             F.when(revisit, F.lit(f"WARC-Profile: {SAME_PAYLOAD}")), F.lit("Content-Type: text/html; charset=utf-8"),
             F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(length.cast("string")))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)).cast("binary")


def header_value(header: Column, name: str) -> Column:
    """The value of a header line; null where the line is missing."""
    found = F.regexp_extract(header.cast("string"), rf"(?md)^{name}: ([^\r\n]*)\r$", 1)
    return F.when(found != "", found)


def page_of(uri: Column) -> Column:
    found = F.regexp_extract(uri, "^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(found != "", found.cast("bigint"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  least: int = 100, date: str = "2024-01-01T00:00:00Z", most: int = BROADCAST_ROWS) -> None:
    """Store the rows of `pages` as WARC records below `path`."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"),
                        text_of(body_col).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    prints = store(rows.select("_id", "digest", F.octet_length("payload").cast("bigint").alias("_length"), "_url"), "prints")
    repeated = repeated_keys(prints, "digest", "repeated", most)
    shared = rows.join(repeated, "digest", "left_semi").groupBy("digest", "payload").agg(F.count(F.lit(1)).alias("_n"))
    single = rows.join(repeated, "digest", "left_anti").select("digest", "payload")
    (single.unionByName(shared.select("digest", "payload")).write.option("compression", "zstd")
     .parquet(f"{path}/payloads"))
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    broken = stored.join(repeated, "digest", "left_semi").groupBy("digest").count().where("count > 1")
    if not broken.isEmpty():
        raise ValueError("two different payloads share a digest")

    first = prints.where(F.col("_length") >= least).join(repeated, "digest", "left_semi").groupBy("digest").agg(
        F.min("_id").alias("_first"))
    r = prints.join(small(store(first, "first"), most), "digest", "left")
    kind = F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), "revisit").otherwise("response")
    header = header_block(F.col("record_type"), F.col("_id"), F.col("_url"), F.col("digest"), F.col("_first"),
                          F.col("_length"), date)
    (r.withColumn("record_type", kind).select(header.alias("header"), "record_type", F.col("digest").alias("payload_digest"))
     .write.parquet(f"{path}/records"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, record_type, payload_digest, payload) per record, each payload checked against its digest."""
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary"))
    records = spark.read.schema("header binary, record_type string, payload_digest string").parquet(f"{path}/records")
    return records.join(payloads.select("digest", checked.alias("payload")),
                        F.col("payload_digest") == F.col("digest"), "left").select(
        "header", "record_type", "payload_digest", "payload")


def record_bytes(header: Column, kind: Column, payload: Column) -> Column:
    """A record as it stands in a .warc file: header, block (empty for a revisit) and two line ends."""
    block = F.when(kind == "revisit", F.lit("").cast("binary")).otherwise(payload)
    return F.concat(header, block, F.lit(CRLF * 2).cast("binary"))


def pages_of(archive: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), all from what was read back."""
    return archive.select(
        page_of(header_value(F.col("header"), "WARC-Record-ID")).alias("page_id"),
        header_value(F.col("header"), "WARC-Target-URI").alias("url"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        header_value(F.col("header"), "WARC-Type").alias("record_type"),
        page_of(header_value(F.col("header"), "WARC-Refers-To")).alias("refers_to"))
