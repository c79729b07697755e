"""Content-addressed WARC archive: payloads once by digest, record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthcast.llm.tables import by_key, stored, table
from monthcast.session import scratch_path

#: Smaller payloads are written as responses even where an equal one exists.
LEAST_REVISIT_BYTES = 100
#: Payloads up to this size travel to the records that hold them; records come to longer ones.
SHORT_BYTES = 1024

# Field names and constants of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("none")), F.lit(">"))


def _clean(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\r\n]+", " ")


def records(
    pages: DataFrame,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    least: int = LEAST_REVISIT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """The two tables of the archive: headers (header binary, digest) and payloads (digest, payload).

    Every page gives a record. Of records with equal payloads of at least
    ``least`` bytes the one with the smallest id is a response, the others
    are revisits that refer to it; a payload's bytes are kept once whatever
    its size. Roles come from digests alone: payload bytes shuffle once, after
    copies within a task have been dropped.

    A null payload is empty, a null uri an empty field. A null id is the
    largest. Rows repeated with the id of the response are responses too.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload")
    ).select("id", "uri", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    light = rows.select("id", "uri", "digest", "size")
    # Written, so that the join has a plain shuffle on either side and Spark can split a large group.
    first = stored(light.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first")), "first")
    role = light.join(first, "digest", "left")
    again = (F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("first"))
    header = F.concat(
        F.lit(VERSION + EOL),
        _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.col("id"))),
        _field("WARC-Target-URI", _clean(F.col("uri"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(_field("WARC-Refers-To", _urn(F.col("first"))), _field("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(EOL),
    )
    headers = role.select(F.encode(header, "UTF-8").alias("header"), "digest")
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    return headers, payloads


def write_archive(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write both tables below ``path``. A folder that exists is an error.

    Returns the payloads as they are stored, bucketed by digest, which this
    session joins without moving them. Any session reads the files.
    """
    headers, payloads = records(pages, **options)
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    return by_key(payloads, "payloads", "digest", path=f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, and what is measured on the stored bytes: payload_bytes, payload_digest."""
    return _measured(spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads"))


def _measured(payloads: DataFrame) -> DataFrame:
    return payloads.select(
        "digest",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )


def _value(name: str) -> Column:
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """header and digest as stored, and what the header bytes say.

    page_id, uri, record_type, refers_to, content_length, and named, the
    digest in the header.
    """
    headers = spark.read.schema("header binary, digest string").parquet(f"{path}/headers")
    number = r"^<urn:page:(-?\d+)>$"
    return headers.select(
        "header",
        "digest",
        F.regexp_extract(_value("WARC-Record-ID"), number, 1).try_cast("long").alias("page_id"),
        _value("WARC-Target-URI").alias("uri"),
        _value("WARC-Type").alias("record_type"),
        F.regexp_extract(_value("WARC-Refers-To"), number, 1).try_cast("long").alias("refers_to"),
        _value("Content-Length").try_cast("long").alias("content_length"),
        F.regexp_replace(_value("WARC-Payload-Digest"), "^sha256:", "").alias("named"),
    )


def _rebuilt(joined: DataFrame) -> DataFrame:
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        "page_id",
        "uri",
        "record_type",
        "refers_to",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.coalesce(F.col("named") == F.col("payload_digest"), F.lit(False)).alias("verified"),
        F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records, headers joined with payloads by digest.

    Columns: page_id, uri, record_type, refers_to from the header bytes;
    payload, payload_bytes, payload_digest from the stored payload, also for
    revisits; verified, whether the stored bytes have the digest the header
    names; record, the exact bytes of the WARC record. Columns a query does
    not ask for, such as the bytes, do not take part in the join.
    """
    return _rebuilt(read_headers(spark, path).join(read_payloads(spark, path), "digest", "left"))


def rebuilt_records(spark: SparkSession, path: str, payloads: DataFrame) -> DataFrame:
    """The records of ``read_records`` without a revisit's payload, which its record does not hold.

    ``payloads`` is what ``write_archive`` returned. Responses, one for each
    payload but for repeated ids, come to the long payloads in their buckets.
    All other records, of which one digest may have any number, take sizes,
    digests and short payloads, in a plain join that Spark can split. The
    record of a short response whose stored bytes have become long is null.
    """
    headers = read_headers(spark, path)
    long = F.coalesce((F.col("record_type") == "response") & (F.col("content_length") > SHORT_BYTES), F.lit(False))
    short = F.when(F.col("payload_bytes") <= SHORT_BYTES, F.col("payload"))
    light = read_payloads(spark, path).withColumn("payload", short)
    whole = _rebuilt(headers.where(long).join(_measured(payloads), "digest", "left"))
    return whole.unionByName(_rebuilt(headers.where(~long).join(light, "digest", "left")))


def archived_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages written as records and read back; an unverified payload has a null digest.

    Every record is rebuilt, and its exact bytes are measured: record_bytes, record_sha256.
    """
    path = scratch_path(spark, "warc")
    payloads = write_archive(table(spark, sf, "pages"), path)
    return rebuilt_records(spark, path, payloads).select(
        "page_id",
        "payload_bytes",
        F.when(F.col("verified"), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        F.octet_length("record").cast("long").alias("record_bytes"),
        F.sha2("record", 256).alias("record_sha256"),
    )
