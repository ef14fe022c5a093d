"""Content-addressed WARC archive.

Two tables: ``payloads`` holds each distinct payload once under its SHA-256; ``headers`` holds, for
every record, its exact header bytes, the HTTP header block and the digest. A record is rebuilt,
byte for byte, by joining the two, and its payload is checked against the digest as it is read.
Equal payloads of at least ``least`` bytes get one response record, that of the smallest id; the
others are revisits that refer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm._shared import cut, read_table, scratch

LEAST = 100
DATE = "2020-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


_END = "\r\n\r\n"


def _record_id(page_id: Column, row: Column) -> Column:
    """A urn:uuid made of the digest of the page's id and the row's number, so that rows repeating an id differ."""
    h = F.sha2(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("null")), row.cast("string")).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archive(pages: DataFrame, root: str, least: int = LEAST, date: str = DATE) -> None:
    """Write ``payloads`` and ``headers`` below ``root`` from ``page_id``, ``url`` and ``html``.

    Null html is an empty payload; a null url an empty target. Rows repeating a ``page_id`` each get
    a record with an id of its own; those with the owner's id and payload are responses. A null
    ``page_id`` never owns a payload that some other page has. Other columns are not stored. An empty
    table gives an empty archive; payloads of any length are stored whole.
    """
    spark = pages.sparkSession
    numbered = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("row", F.monotonically_increasing_id())
    records = cut(numbered.select("page_id", "url", "row", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("size")))
    # One row of each digest brings the payload: only those are shuffled.
    owners = cut(records.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("owner"), F.first("size").alias("size")))
    rows = owners.select(F.col("owner.row").alias("row"), "digest")
    numbered.select("row", "payload").join(rows, "row").select("digest", "payload").write.option("compression", "zstd").parquet(f"{root}/payloads")
    owners = owners.filter(F.col("size") >= least).select("digest", F.col("owner.page_id").alias("owner"), F.col("owner.row").alias("owner_row"), F.lit(True).alias("large"))
    revisit = F.col("large").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    records = records.join(owners, "digest", "left").withColumn("revisit", revisit)
    http = F.concat(F.lit(_HTTP), F.col("size").cast("string"), F.lit(_END))
    block = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    lines = [
        F.lit("WARC/1.1"),
        F.when(F.col("revisit"), F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("row"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("owner"), F.col("owner_row")))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
        F.lit("\r\n"),
    ]
    records.select("page_id", "digest", F.concat_ws("\r\n", *lines).cast("binary").alias("header"), http.cast("binary").alias("http")).write.option("compression", "zstd").parquet(f"{root}/headers")


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """Every record: page_id, ``record`` (exact bytes, closing blank lines included) and ``stored``, the payload under its digest.

    A payload whose digest differs from its address, or is missing, raises.
    """
    payloads = spark.read.parquet(f"{root}/payloads").withColumn("actual", F.sha2("payload", 256))
    records = spark.read.parquet(f"{root}/headers").join(payloads, "digest", "left")
    sound = F.col("actual").eqNullSafe(F.col("digest"))
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("broken payload "), F.col("digest"))).cast("binary"))
    records = records.withColumn("stored", payload)
    end = F.lit(_END).cast("binary")
    response = F.col("header").cast("string").contains("\r\nWARC-Type: response\r\n")
    record = F.when(response, F.concat("header", "http", "stored", end)).otherwise(F.concat("header", "http", end))
    return records.select("page_id", record.alias("record"), "stored")


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)(?:\r\n|$)", 1), F.lit(""))


def parse_records(records: DataFrame) -> DataFrame:
    """Read ``record`` bytes: adds record_type, record_id, refers_to_record, digest (of the header) and ``payload``.

    The payload is what the record holds after its HTTP header; a revisit holds none and gets ``stored``.
    """
    out = records.withColumn("head", F.substring_index(F.col("record").cast("string"), _END, 1))
    length = _field(F.col("head"), "Content-Length").cast("int")
    out = out.withColumn("block", F.substring(F.col("record"), F.octet_length("head") + 5, length))
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), _END, 1))
    kind = _field(F.col("head"), "WARC-Type")
    held = F.substring(F.col("block"), http + 5, F.octet_length("block") - http - 4)
    out = out.withColumn("payload", F.when(kind == "response", held).otherwise(F.col("stored")))
    return out.select("page_id", "payload", kind.alias("record_type"), _field(F.col("head"), "WARC-Record-ID").alias("record_id"), _field(F.col("head"), "WARC-Refers-To").alias("refers_to_record"),
                      F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha256:", "").alias("digest"))


def export_warc(spark: SparkSession, root: str, path: str) -> None:
    """Plain .warc files of all records: Spark's text writer puts the records' closing blank lines itself."""
    records = read_archive(spark, root)
    body = F.expr("substring(record, 1, length(record) - 4)")
    records.select(F.decode(body, "UTF-8").alias("value")).write.option("lineSep", _END).text(path)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    write_archive(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), root)
    read = parse_records(read_archive(spark, root)).withColumn("actual", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    same = F.when(F.col("actual") == F.col("digest"), F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("record and header differ: "), F.col("record_id"))))
    read = cut(read.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "record_id", "refers_to_record"))
    named = read.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    return read.join(named, "refers_to_record", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, min(page_id) AS owner FROM p WHERE n >= {LEAST} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN owner IS NULL OR page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to FROM p LEFT JOIN o ON p.d = o.d"""
