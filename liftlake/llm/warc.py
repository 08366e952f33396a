"""Content-addressed WARC archive.

``write_archive`` keeps two tables: ``payloads`` holds the bytes of each
distinct payload once, under its SHA-256 (verified by SHA-1 and length: rows
share a payload only if all three agree), and ``headers`` holds the exact
header block of every record with the digest of its payload. ``read_archive``
rebuilds the original records by joining the two and checks each payload
against both digests. ``export_warc`` writes plain WARC/1.1 text files.

Of records with equal payloads the one with the smallest page_id is the
``response``; the others are ``revisit`` records that refer to it. Payloads
below ``min_revisit_bytes`` are always responses.

Defined cases: null html is an empty payload; null page ids come after every
id; repeated rows give one response and revisits to it; a null url gives an
empty target; an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.llm.common import scratch, stored

EOL = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DEFAULT_DATE = "2024-01-01T00:00:00Z"
_RADIX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 8 groups of 20 bits, 4 letters each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _RADIX32, _BASE32)


def _record_id(page_id: Column, row: Column) -> Column:
    """A stable urn: the page id, and the row number that tells repeated ids apart."""
    digest = F.sha2(F.concat_ws("/", page_id.cast("string"), row.cast("string")), 256)
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(date: str) -> Column:
    """The exact header block, without the blank line that ends it."""
    # A line break inside a URL would start a new header: it is percent-encoded.
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), "refers_to_record")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return F.concat_ws(EOL, *lines)


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = DEFAULT_DATE) -> None:
    """Write ``pages(page_id, url, html, ...)`` as the archive at ``path``."""
    html = F.coalesce("html", F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = stored(source.select(
        "page_id", "url", F.octet_length("html").cast("long").alias("payload_bytes"), base32_sha1(F.col("html")).alias("payload_digest"),
        F.unhex(F.sha2("html", 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "warc-rows")
    same = ["digest", "payload_digest", "payload_bytes"]
    # Payload bytes meet once per (task, digest) before the shuffle; a payload with many copies moves as one row a task.
    (source.select("html", F.unhex(F.sha2("html", 256)).alias("digest"), base32_sha1(F.col("html")).alias("payload_digest"),
                   F.octet_length("html").cast("long").alias("payload_bytes"))
     .groupBy(*same).agg(F.first("html").alias("payload")).write.parquet(f"{path}/payloads"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    # Stored, so that the join below exchanges both sides itself and a hot payload's rows can be split.
    first = stored(rows.groupBy(*same).agg(F.min(order).alias("first")).withColumnsRenamed({c: f"_{c}" for c in same}), "warc-first")
    match = (rows["digest"] == first["_digest"]) & (rows["payload_digest"] == first["_payload_digest"]) & (rows["payload_bytes"] == first["_payload_bytes"])
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & (F.col("row") != F.col("first.row"))
    records = (rows.join(first, match)
               .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
               .withColumn("refers_to", F.when(revisit, F.col("first.page_id")))
               .withColumn("record_id", _record_id(F.col("page_id"), F.col("row")))
               .withColumn("refers_to_record", F.when(revisit, _record_id(F.col("first.page_id"), F.col("first.row")))))
    (records.withColumn("header", _header(date))
     .select("record_id", "page_id", "digest", "refers_to", "header").write.parquet(f"{path}/headers"))


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?m)^{name}: ?(.*?)\r?$", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record, rebuilt: page_id, record_type, refers_to, header, payload, payload_bytes, payload_digest, intact.

    A revisit record gets the payload of its response through the digest.
    ``intact`` says that the payload read back has the strong digest it is
    stored under and the digest that the record's header names."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = (spark.read.parquet(f"{path}/payloads")
                .select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
                        base32_sha1(F.col("payload")).alias("payload_digest"),
                        (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("strong")))
    named = _field("WARC-Payload-Digest")
    return headers.join(payloads, "digest").select(
        "page_id", _field("WARC-Type").alias("record_type"), "refers_to", "record_id", "header", "payload", "payload_bytes", "payload_digest",
        (F.col("strong") & (named == F.concat(F.lit("sha1:"), F.col("payload_digest")))).alias("intact"))


def export_warc(records: DataFrame, path: str, records_per_file: int = 50_000) -> None:
    """Write rebuilt records as WARC/1.1 files: header, blank line, block, two line ends."""
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    (records.select(F.concat("header", F.lit(EOL * 2), block).alias("value"))
     .write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and return its rebuilt records."""
    path = scratch(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
