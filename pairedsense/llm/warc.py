"""WARC archives with revisit resolution.

Writing: every record gets a digest of its payload; only headers (id, digest,
length) are shuffled by digest, where the least id of equal payloads of
``MIN_BYTES`` or more becomes the response and the others revisits that refer to
it. The decisions go back to the records by id, and Spark's text writer stores
them: a record is its header block and its payload, the writer's separator the
two line ends that close a record. Files hold a bounded number of records.

Reading: files come through Spark's binary reader and are cut by Content-Length,
so a payload may contain anything, also the start of another record. Revisits
are joined with the responses they refer to; headers are rewritten from the
payload, and ``dedupe`` writes archives it has read once more, with fresh
headers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, stage

MIN_BYTES = 100
RECORDS_PER_FILE = 1000
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the format.
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"
_END = "\r\n\r\n"
_READ = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, html string, sound boolean"


def mark_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest) with record_type and refers_to.

    The grouping combines before the shuffle and AQE deals the join back, so one
    payload may be that of a third of all pages. Rows without page_id stay responses.
    """
    shared = headers.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    first = shared.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marked = headers.join(first, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("payload_bytes") >= min_bytes) & (F.col("page_id") > F.col("first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    return marked.select(
        "page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def record_id(page_id: Column) -> Column:
    """A urn that depends on the page only, in the form of a UUID."""
    h = F.md5(F.concat(F.lit("page-"), F.coalesce(page_id.cast("string"), F.lit("none"))))
    return F.concat(F.lit("<urn:uuid:"), *[p for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for p in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(_EOL))


def render(records: DataFrame, date: str = DATE) -> DataFrame:
    """(value): the records (page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) as WARC text."""
    html = F.coalesce(F.col("html"), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}"), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(_EOL)
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(html))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit(_VERSION + _EOL),
        F.concat(F.lit("WARC-Type: "), F.col("record_type"), F.lit(_EOL)),
        _line("WARC-Record-ID", record_id(F.col("page_id"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", record_id(F.col("refers_to"))), _line("WARC-Profile", _PROFILE), _line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        _line("X-Page", page),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_EOL),
    )
    return records.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html, ...) as archives below ``path``, equal payloads once.

    * A null html is an empty payload; payloads below ``min_bytes`` are always responses.
    * Rows with an equal page_id are records of their own (equal ids in the archive); where their payloads
      are equal and the least, all of them are responses. Without page_id a record has an empty X-Page.
    * White space and control characters of a url are written as %20. Other columns are not read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    described = pages.select(
        "page_id", "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest")
    )
    headers = described.select("page_id", "payload_bytes", "payload_digest").distinct()
    decided = stage(mark_revisits(headers, min_bytes).filter("record_type = 'revisit'"), "revisits")
    decided = decided.select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "record_type", "refers_to")
    same = (F.col("page_id") == F.col("id")) & (F.col("payload_digest") == F.col("digest"))
    records = described.join(decided, same, "left").drop("id", "digest").withColumn("record_type", F.coalesce("record_type", F.lit("response")))
    render(records, date).write.option("lineSep", _END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record."""
    at, end = 0, len(raw)
    while at < end:
        close = raw.index(b"\r\n\r\n", at)
        lines = raw[at:close].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = close + 4
        stop = start + int(fields["content-length"])
        yield fields, raw[start:stop]
        at = stop + 4


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("html", pa.string()), ("sound", pa.bool_())]
    )
    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            for fields, block in parse(content.as_buffer().to_pybytes()):
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                stated = fields["warc-payload-digest"].removeprefix("sha256:")
                kind, page, refers = fields["warc-type"], fields.get("x-page", ""), fields.get("x-refers-to-page")
                own = stated if kind == "revisit" else hashlib.sha256(payload).hexdigest()
                size, text = (None, None) if kind == "revisit" else (len(payload), payload.decode("utf-8"))
                rows.append((int(page) if page else None, kind, int(refers) if refers else None, fields.get("warc-target-uri", ""), size, own, text, own == stated))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``; ``sound`` tells whether a payload has the digest that its header states.

    A revisit has no payload of its own: payload_bytes and html are NULL until ``resolve``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse, _READ)


def resolve(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Revisits with the payload (or only its length) of the response that they refer to."""
    carried = ["payload_bytes", "html"] if with_payload else ["payload_bytes"]
    first = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), *[F.col(c).alias(f"_{c}") for c in carried]
    ).dropDuplicates(["_page", "_digest"])
    same = (records["refers_to"] == F.col("_page")) & (records["payload_digest"] == F.col("_digest"))
    out = records.join(first, same, "left")
    for c in carried:
        out = out.withColumn(c, F.coalesce(c, f"_{c}"))
    return out.select(*[c for c in records.columns if with_payload or c != "html"])


def dedupe(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Read archives, resolve their revisits and write them once more with equal payloads stored once."""
    write(resolve(read(spark, source)), target, min_bytes, date)


def roundtrip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read these back, revisits resolved (without payloads)."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, min_bytes)
    return resolve(stage(read(spark, path).drop("html"), "records"), with_payload=False)


def summary(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
