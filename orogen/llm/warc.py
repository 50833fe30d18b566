"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256. Every record's exact header
bytes are kept in a table of their own. Original records come back through a
join of the two, and each payload is held against its digest on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm.common import stored

#: Payloads under so many bytes are never written as revisits.
REVISIT_LEAST = 1000
CRLF = "\r\n"
#: Extension field of revisits: the page of the record that they refer to.
REFERRED = "Refers-To-Page"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Where an archive's two tables lie."""

    path: str

    @property
    def headers(self) -> str:
        return f"{self.path}/headers.parquet"

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads.parquet"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _record_id(path: str, number: Column) -> Column:
    """A UUID of a record's number in the archive at ``path``."""
    h = F.sha1(F.concat_ws("\n", F.lit(path), number).cast("binary"))
    at = lambda start, n: F.substring(h, start, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12)), F.lit(">"))


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Writes one record per row and each distinct payload once.

    Of the records with equal payloads of :data:`REVISIT_LEAST` bytes or more,
    those with the largest id are responses and the others revisit that id; if
    no id is known all are responses. Null payloads count as empty, null URLs
    as ``urn:page:<id>``; line ends in a URL are written as %0D and %0A. Equal
    rows give records that differ in their id only. A revisit names the record
    that it refers to by its id, and that record's page in an extension field.
    An empty table gives an empty archive. Other columns are not read.
    """
    spark = df.sparkSession
    archive = Archive(path.rstrip("/"))
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    name = F.coalesce(F.col(url_col).cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = df.select(F.col(id_col).alias("id"), F.replace(F.replace(name, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))

    # Partial aggregation leaves one row of a payload for each task, however many records have it.
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(archive.payloads)

    # Numbers are given once and written, so a record keeps its number whatever happens to executors.
    small = rows.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), F.monotonically_increasing_id().alias("number"))
    small = stored(small, "warc-records")
    row = F.when(F.col("id").isNotNull(), F.struct("id", "number"))
    groups = small.where(F.col("bytes") >= REVISIT_LEAST).groupBy("digest").agg(F.max(row).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("first.id").alias("first"), F.col("first.number").alias("first_number"))
    # One group may hold a third of the records; adaptive execution splits such a join's tasks.
    joined = small.join(groups, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(archive.path, F.col("number"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(archive.path, F.col("first_number"))), _line(REFERRED, F.col("first").cast("string")))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
    )
    joined.select("id", "digest", F.encode(head, "UTF-8").alias("header")).write.parquet(archive.headers)
    return archive


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Reconstructed records: ``id``, ``header``, ``payload`` and ``record`` (exact bytes).

    A revisit's record ends after its header block; its payload is joined from
    the store all the same. A payload that doesn't have the digest that it is
    stored under raises an error.
    """
    store = spark.read.parquet(archive.payloads)
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload fails its digest: "), F.col("digest"))))
    store = store.select("digest", sound.alias("payload"))
    joined = spark.read.parquet(archive.headers).join(store, "digest")
    revisit = F.decode("header", "UTF-8").contains(f"{CRLF}WARC-Type: revisit{CRLF}")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    body = F.when(revisit, end).otherwise(F.concat(F.col("payload"), end))
    return joined.select("id", "header", "payload", F.concat(F.col("header"), body).alias("record"))


def field(header: Column, name: str) -> Column:
    """A header line's value; null if there is no such line."""
    found = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(header.rlike(rf"(?:^|\r\n){name}: "), found)


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """Parses every reconstructed record.

    Gives ``id``, ``record_id``, ``refers_to_record``, ``url``, ``record_type``, ``refers_to`` (the id, as text),
    ``payload``, ``payload_bytes`` and ``payload_digest`` (SHA-1 of the payload
    as read, which must be the one that the header states).
    """
    parts = records(spark, archive).withColumn("text", F.decode("header", "UTF-8"))
    sha1 = F.sha1("payload")
    stated = F.concat(F.lit("sha1:"), sha1) == field(F.col("text"), "WARC-Payload-Digest")
    head = F.octet_length(F.encode(F.substring_index("text", CRLF * 2, 1), "UTF-8")) + 4
    whole = F.octet_length("record") == head + field(F.col("text"), "Content-Length").cast("long") + 4
    return parts.select(
        "id",
        field(F.col("text"), "WARC-Target-URI").alias("url"),
        field(F.col("text"), "WARC-Type").alias("record_type"),
        field(F.col("text"), "WARC-Record-ID").alias("record_id"),
        field(F.col("text"), "WARC-Refers-To").alias("refers_to_record"),
        field(F.col("text"), REFERRED).alias("refers_to"),
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(stated & whole, sha1).otherwise(F.raise_error(F.lit("a record doesn't match its header"))).alias("payload_digest"),
    )
