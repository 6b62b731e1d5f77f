"""WARC archives without repeated payloads.

Payloads are compared by digest: thin headers (page, size, digest) are shuffled by digest to find the first page of
each payload, every other page of it becomes a revisit record that refers to the first one's record, and archives are
written anew with fresh headers. Reading takes the archives apart by their Content-Length and joins revisits to the
responses they name, so that every page has its payload's size and digest again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeflow.llm.common import importable
from typeflow.session import new_folder

#: Payloads below this size are stored again each time: a revisit record would be no shorter.
LEAST_BYTES = 100
#: Records in one archive file: a task reads a file as a whole.
FILE_RECORDS = 4096
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The HTTP header block that stands before each payload.
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
SCHEMA = (
    "page_id bigint, record_type string, record_id string, refers_to_record string, refers_to bigint, url string, "
    "payload_bytes bigint, payload_digest string"
)


def headers(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``payload_bytes`` and ``payload_digest``; a null html is empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("bigint"),
        F.col("url").cast("string"),
        html.alias("payload"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"),
        F.sha2(html, 256).alias("payload_digest"),
    )


def resolved(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Every row of ``pages`` as the record it becomes: ``record_type`` and, of a revisit, ``refers_to``.

    Of rows with equal payloads of ``least_bytes`` or more, the one with the smallest page_id is the response; smaller
    payloads are always responses. Rows repeated with that smallest page_id are all responses. A null page_id counts
    as larger than all others, and if a payload has no other page, each of its rows is a response. Further columns
    are left out. The join is on digests; the side with one row per digest comes from an aggregation that combines
    before its shuffle, and adaptive execution splits a digest that many pages have.
    """
    rows = headers(pages)
    firsts = (
        headers(pages)
        .filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 and first is not null")
        .select("payload_digest", "first")
    )
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return rows.join(firsts, "payload_digest", "left").select(
        "page_id",
        "url",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
        "payload",
        "payload_bytes",
        "payload_digest",
    )


def _record_id(page_id: Column) -> Column:
    """A record's id follows from its page and payload, so that a task run again writes the same archive, and payloads
    that one page has at different times are told apart. A revisit's payload has its response's digest."""
    page = F.coalesce(page_id.cast("string"), F.lit("none"))
    h = F.sha2(F.concat(F.lit("page:"), page, F.lit(":"), F.col("payload_digest")), 256)
    parts = [F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_bytes(row_columns: DataFrame, date: str = DATE) -> DataFrame:
    """The records as they stand in the archive, without the two line ends that close each one."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(HTTP).cast("binary")).otherwise(
        F.concat(F.lit(HTTP).cast("binary"), F.col("payload"))
    )
    # A line break or other control character in a field's value would end the field.
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    fields = [
        (F.lit("WARC-Type"), F.col("record_type")),
        (F.lit("WARC-Record-ID"), _record_id(F.col("page_id"))),
        (F.lit("WARC-Date"), F.lit(date)),
        (F.lit("WARC-Target-URI"), url),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        (F.lit("WARC-Profile"), F.when(revisit, F.lit(PROFILE))),
        (F.lit("WARC-Refers-To"), F.when(revisit, _record_id(F.col("refers_to")))),
        (F.lit("X-Page-ID"), F.col("page_id").cast("string")),
        (F.lit("X-Refers-To-Page-ID"), F.col("refers_to").cast("string")),
        (F.lit("Content-Type"), F.lit("application/http; msgtype=response")),
        (F.lit("Content-Length"), F.octet_length("block").cast("string")),
    ]
    lines = F.concat_ws(CRLF, F.lit("WARC/1.1"), *[F.concat(name, F.lit(": "), value) for name, value in fields])
    head = F.concat(lines, F.lit(CRLF + CRLF)).cast("binary")
    return row_columns.withColumn("block", block).select(F.concat(head, F.col("block")).cast("string").alias("value"))


def write_archive(records: DataFrame, path: str | None = None, file_records: int = FILE_RECORDS) -> str:
    """Writes gzip archives of at most ``file_records`` records, by Spark's own writer, and returns their folder.

    A WARC record ends with two line ends, which are the writer's line separator here; so files are committed as
    any Spark output and any file system will do.
    """
    spark = records.sparkSession
    path = path or new_folder(spark, "warc")
    writer = record_bytes(records).write.option("maxRecordsPerFile", file_records)
    writer.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
    return path


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a gzip file: their fields, lower-case names, and their blocks."""
    raw, rest = b"", data
    while rest:  # each member of the file
        unzip = zlib.decompressobj(31)
        raw += unzip.decompress(rest) + unzip.flush()
        rest = unzip.unused_data
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, raw[start:stop]
        at = stop + 4


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in ``path``. Size and digest are those of the block's payload, computed anew; a
    response whose payload doesn't match its header's digest raises an error. Revisits have neither yet."""
    importable(spark)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                            ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in records_of(content.as_py()):
                    revisit = fields["warc-type"] == "revisit"
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest = None if revisit else hashlib.sha256(payload).hexdigest()
                    if not revisit and fields["warc-payload-digest"] != f"sha256:{digest}":
                        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
                    rows.append((number(fields.get("x-page-id")), fields["warc-type"], fields["warc-record-id"],
                                 fields.get("warc-refers-to"), number(fields.get("x-refers-to-page-id")),
                                 fields.get("warc-target-uri"), None if revisit else len(payload), digest))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema],
                    schema=schema,
                )

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(take, SCHEMA)


def joined(records: DataFrame) -> DataFrame:
    """Revisits with the size and digest of the response they refer to; responses as they are.

    ``records`` is read more than once: a stored table. Only revisits are joined, so that records without a reference
    don't meet in one task; adaptive execution splits a response with many revisits.
    """
    found = records.filter("record_type = 'response'")
    named = found.groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")
    )
    again = records.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    return found.unionByName(again.join(named, "refers_to_record", "left"))
