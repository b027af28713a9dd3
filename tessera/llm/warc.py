"""Content-addressed WARC archive.

``records`` keeps each record's exact header, the HTTP header in front of its payload,
its type and the payload's digest; ``payloads`` keeps each payload's bytes once, under
their SHA-256.  Reading hashes the stored bytes again, and joins headers to payloads by
digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, new_path, text_bytes, written

#: Payloads of fewer bytes are written out by every record.
REVISIT_BYTES = 100
CRLF = "\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Of a response, what stands before the payload.
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "
#: When pages were taken, where nothing else is known; the format asks for a date.
DATE = "1970-01-01T00:00:00Z"


def _http() -> F.Column:
    """The HTTP header of a response; a revisit has none."""
    whole = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    return F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(whole)


def _headers(date: str) -> F.Column:
    """The header of a record, with the empty line that ends it."""

    def line(name: str, value: F.Column) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    # a page's id and the row's number, as ids may be missing or repeat
    urn = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    # line ends would break the header apart, so they are escaped like spaces in a URI
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    length = F.when(revisit, F.lit(0).cast("long")).otherwise(F.octet_length(_http()) + F.col("bytes"))
    return F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"), F.col("row"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("first.page_id"), F.col("first.row")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> str:
    """Write ``pages`` to the archive folder ``path`` (a new one in the shared folder by default); returns it.

    Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, those of
    the smallest id are ``response`` and all others ``revisit`` that one; shorter
    payloads, null counting as empty, always make a ``response``.  If rows repeat
    the smallest id, each of them is a response; the bytes are still stored once.
    Rows without an id are written with the id ``none``, and each record's name has its row's
    number, so that it is the only one; they revisit the smallest
    id that there is, and where there is none they are responses.  An empty table
    makes an empty archive.
    """
    path = path or new_path(pages.sparkSession, "archive")
    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_bytes(F.col(html_col)).alias("payload"))
    hashed = raw.withColumn("digest", F.sha2("payload", 256))
    # ids and digests are grouped and joined without the payloads
    row = F.monotonically_increasing_id().alias("row")
    seen = written(hashed.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), row), "seen")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))
    first = written(seen.groupBy(F.col("digest").alias("d")).agg(F.min(named).alias("first")), "first")

    known = seen.join(first, F.col("digest") == F.col("d"))
    again = (F.col("bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    typed = known.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    typed.select(_headers(date).alias("header"), _http().cast("binary").alias("http"), "record_type", "digest").write.parquet(f"{path}/records")

    # each payload moves once, to where those who keep it are known; all but one row of each digest end there
    keepers = first.select("d", F.coalesce("first.page_id", F.lit(-1)).alias("keeper"))
    own = hashed.select("digest", "payload", F.coalesce("page_id", F.lit(-1)).alias("own"))
    once = own.join(keepers, (F.col("digest") == F.col("d")) & (F.col("own") == F.col("keeper")), "left_semi")
    once.dropDuplicates(["digest", "own"]).select("digest", "payload").write.parquet(f"{path}/payloads")
    discard(seen, first)
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(digest, payload, bytes)``; fails on bytes that don't have the digest under which they are stored."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    found = F.sha2("payload", 256)
    verified = F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.concat(F.lit("stored payload isn't "), F.col("digest"))))
    return stored.select(verified.alias("digest"), "payload", F.octet_length("payload").cast("long").alias("bytes"))


def parse_headers(records: DataFrame) -> DataFrame:
    """The fields of ``header`` as columns: page_id, url, record_type, payload_digest, refers_to."""
    text = F.col("header").cast("string")

    def field(name: str) -> F.Column:
        return F.regexp_extract(text, f"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)

    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+):[0-9]+>", 1).try_cast("long")
    return records.select(
        number(field("WARC-Record-ID")).alias("page_id"),
        F.when(F.contains(text, F.lit("\r\nWARC-Target-URI: ")), field("WARC-Target-URI")).alias("url"),
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Payload-Digest"), "sha256:([0-9a-f]{64})", 1).alias("payload_digest"),
        number(field("WARC-Refers-To")).alias("refers_to"),
        *[c for c in records.columns if c not in ("page_id", "url", "record_type", "payload_digest", "refers_to")],
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Each record with its header fields and its full payload, revisits included."""
    records = spark.read.schema("header binary, http binary").parquet(f"{path}/records")
    parsed = parse_headers(records)
    both = parsed.join(read_payloads(spark, path), F.col("payload_digest") == F.col("digest"))
    return both.select(*parsed.columns, "payload", F.col("bytes").alias("payload_bytes"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record)``: each record's exact bytes, as a WARC file has them; a revisit has no block."""
    read = read_archive(spark, path)
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.concat("http", "payload"))
    return read.select("page_id", F.concat("header", block, F.lit(CRLF + CRLF).cast("binary")).alias("record"))
