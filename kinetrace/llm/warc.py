"""Content-addressed WARC archive.

``payloads`` holds each distinct payload once, under its SHA-256; a second digest and the length must agree among all rows that
share it, else the write fails. ``headers`` holds every record's exact header block and its payload's key. A record is its header
block, the payload if it is a response, and two line ends; it is rebuilt by a join of the two tables.

Of records with equal payloads of at least ``least`` bytes, that with the largest page_id is the response and the others revisit
it; smaller ones are all responses. Null html counts as empty. Repeated page_ids are records of their own (all are compared by
page_id, so rows with equal page_id and payload are responses together). Null page_ids sort lowest. Extra columns don't matter.

A payload that a third of all rows share is one row in the grouping's second step, since each task sums up first; the joins carry
digests and ids, no payloads, and Spark splits their large partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

END = "\r\n"
#: Every record must have a date; pages have none of their own.
DATE = "1970-01-01T00:00:00Z"


def _header(kind: Column, date: str) -> Column:
    """The header block of a record, without its payload."""
    length = F.when(kind == "response", F.col("n")).otherwise(F.lit(0))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("owner").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", length.cast("string")),
        F.lit(END),
    ).cast("binary")


def write_archive(scratch: Scratch, pages: DataFrame, least: int = 1000, date: str = DATE) -> None:
    """Writes the tables ``payloads`` and ``headers`` below ``scratch``, or a :class:`~.common.Folder` that stays. ``date``: of the capture."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", body.alias("payload")).select("page_id", "url", F.unhex(F.sha2("payload", 256)).alias("key"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("n"))
    keyed = scratch.write(keyed, "keyed")
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit("two payloads share a SHA-256")).cast(dict(keyed.dtypes)[c]))
    owners = scratch.write(keyed.groupBy("key").agg(F.max("page_id").alias("owner"), same("sha1").alias("sha1"), same("n").alias("n")), "owners")
    revisit = (F.col("n") >= least) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    records = keyed.select("page_id", "url", "key").join(owners, "key").withColumn("kind", kind)
    records.select("page_id", "key", _header(F.col("kind"), date).alias("header")).write.option("compression", "zstd").parquet(scratch.path("headers"))
    # The bytes themselves: from the row that owns them, found by (page_id, key), so payloads are shuffled once and no group is large.
    whole = pages.select("page_id", body.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    own = owners.select(F.col("key").alias("own_key"), "owner")
    stored = whole.join(own, (F.col("key") == F.col("own_key")) & F.col("page_id").eqNullSafe(F.col("owner")), "left_semi")
    if keyed.groupBy("page_id").count().where("count > 1").limit(1).count():
        stored = stored.dropDuplicates(["key"])  # rows may share an owner's page_id and payload
    stored.select("key", "payload").write.option("compression", "zstd").parquet(scratch.path("payloads"))
    for name in ("keyed", "owners"):
        scratch.drop(name)


def read_headers(scratch: Scratch) -> DataFrame:
    """Records as their header blocks say: page_id, record_type, refers_to, payload digest and length, key."""
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda c: F.expr(f"try_cast(nullif({c}, '') as bigint)")
    cut = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1)
    got = scratch.spark.read.parquet(scratch.path("headers")).select("key", "header", cut(field("WARC-Record-ID")).alias("a"), field("WARC-Type").alias("record_type"), cut(field("WARC-Refers-To")).alias("b"), field("WARC-Payload-Digest").alias("digest"), field("X-Payload-Length").alias("length"))
    return got.select(number("a").alias("page_id"), "record_type", number("b").alias("refers_to"), F.substring("digest", 6, 40).alias("digest"), F.col("length").cast("bigint").alias("length"), "key", "header")


def read_payloads(scratch: Scratch) -> DataFrame:
    """Payloads, each held against its key."""
    got = scratch.spark.read.parquet(scratch.path("payloads"))
    broken = F.unhex(F.sha2("payload", 256)) != F.col("key")
    return got.select("key", F.when(broken, F.raise_error(F.lit("a payload doesn't match its digest")).cast("binary")).otherwise(F.col("payload")).alias("payload"))


def reconstruct(scratch: Scratch) -> DataFrame:
    """(page_id, record): the bytes of each original record."""
    ends = F.lit(END + END).cast("binary")
    both = read_headers(scratch).join(read_payloads(scratch), "key", "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return both.select("page_id", F.concat("header", body, ends).alias("record"))


def archive_report(scratch: Scratch) -> DataFrame:
    """Per record, from the archive: page_id, payload_bytes, payload_digest (both of the payload as read), record_type, refers_to."""
    held = read_payloads(scratch).select("key", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    both = read_headers(scratch).join(held, "key", "left")
    wrong = ~(F.col("digest").eqNullSafe(F.col("payload_digest")) & F.col("length").eqNullSafe(F.col("payload_bytes")))
    checked = F.when(wrong, F.raise_error(F.lit("a header doesn't match its payload"))).otherwise(F.col("payload_digest"))
    return both.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
