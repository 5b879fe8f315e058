"""Web archives: captures written as linked records, read back and put together again."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm.shared import shared_path, written

#: Payloads of fewer bytes are always stored whole.
LEAST_SHARED = 100
#: Records of one archive file; a capture has three.
RECORDS_A_FILE = 1500
_END = "\r\n"


def _record_id(kind: str, page: Column, digest: Column) -> Column:
    """A name that follows from the capture, so that a repeated task writes the same records."""
    raw = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(raw, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str | Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # a null value leaves its line out
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), F.lit(""), block]
    return F.concat_ws(_END, *lines)


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(page, digest, first): captures whose payload an earlier capture, that with the least id, has already stored; an id may have several payloads."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    slim = pages.select(pages[id_col].alias("page"), F.octet_length(payload).alias("size"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    slim = written(slim.where(F.col("size") >= LEAST_SHARED).select("page", "digest"))
    firsts = written(slim.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    return written(slim.join(firsts, "digest").where("page <> first").select("page", "digest", "first").distinct())


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  captured_at: str = "2024-01-01T00:00:00Z") -> None:
    """Write a request, a response or revisit, and a metadata record for each page, as gzipped WARC files.

    The request and the metadata name the response as concurrent to them; a revisit refers to
    the response that stored its payload. Files come from Spark's own text writer with the
    records' closing lines as separator, so they are committed per task and survive lost
    executors. A null payload is empty, a null url leaves its header out, line breaks in urls
    are dropped. A page with a null id is always stored as a response.
    """
    again = revisits(pages, id_col, payload_col)
    body = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].alias("page"), F.regexp_replace(pages[url_col].cast("string"), r"[\r\n]", "").alias("url"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"))
    rows = rows.join(again, ["page", "digest"], "left")
    own = _record_id("response", F.col("page"), F.col("digest"))
    revisit = F.col("first").isNotNull()
    date, uri = ("WARC-Date", F.lit(captured_at)), ("WARC-Target-URI", F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.octet_length("body").cast("string"), F.lit(_END * 2))
    records = F.array(
        _record("request", [("WARC-Record-ID", _record_id("request", F.col("page"), F.col("digest"))), date, uri, ("WARC-Concurrent-To", own),
                            ("Content-Type", F.lit("application/http;msgtype=request"))],
                F.concat(F.lit("GET "), F.coalesce("url", F.lit("")), F.lit(f" HTTP/1.1{_END * 2}"))),
        _record(F.when(revisit, "revisit").otherwise("response"),
                [("WARC-Record-ID", own), date, uri, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                 ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                 ("WARC-Refers-To", F.when(revisit, _record_id("response", F.col("first"), F.col("digest")))),
                 ("Content-Type", F.lit("application/http;msgtype=response"))],
                F.when(revisit, http).otherwise(F.concat(http, F.col("body")))),
        _record("metadata", [("WARC-Record-ID", _record_id("metadata", F.col("page"), F.col("digest"))), date, uri, ("WARC-Concurrent-To", own),
                             ("Content-Type", F.lit("application/warc-fields"))],
                F.concat(F.lit("page-id: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(_END))),
    )
    (rows.select(F.explode(records).alias("value")).write.option("lineSep", _END * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_A_FILE).text(path))


_RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, payload_bytes bigint, fields string, payload binary"
_NAMES = [f.split()[0] for f in _RECORD.split(", ")]


def _lines(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in raw.split(b"\r\n"))
    return {name.strip().lower().decode(): value.strip().decode("utf-8", "replace") for name, _, value in pairs if name}


def _parse(stream: io.BufferedIOBase, with_payload: bool) -> Iterator[dict]:
    """The records of one archive, by their stated lengths."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        raw = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            raw.append(line.rstrip(b"\r\n"))
        head = _lines(b"\r\n".join(raw))
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("an archive ends within a record")
        kind = head["warc-type"]
        row = {"record_id": head.get("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"),
               "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "digest": None, "payload_bytes": None, "fields": None, "payload": None}
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            stated = (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None
            row["digest"] = hashlib.sha256(payload).hexdigest() if kind == "response" else stated
            if stated and row["digest"] != stated:
                raise ValueError(f"{row['record_id']}: the payload does not have its digest")
            row["payload_bytes"] = len(payload) if kind == "response" else int(_lines(http).get("content-length", 0))
            row["payload"] = payload if with_payload and kind == "response" else None
        else:
            row["fields"] = block.decode("utf-8", "replace")
        yield row


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records below ``path``; files are unpacked as streams, lengths and digests are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in _NAMES])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in _parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer().to_pybytes()))), with_payload):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 300
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(parse, _RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its id, and the response, request and metadata that are concurrent.

    A response or revisit names the capture; requests and metadata find it by the record they
    are concurrent to. Missing parts are null, and so is the response of records whose
    counterpart is in no archive. Repeated records, as equal pages make them, are one capture.
    All parts of a capture meet in one pre-aggregated grouping.
    """
    answer = F.col("type").isin("response", "revisit")

    def part(test: Column, *names: str) -> Column:
        return F.first(F.when(test, F.struct(*names)), ignorenulls=True)

    return records.withColumn("capture", F.when(answer, F.col("record_id")).otherwise(F.col("concurrent_to"))).groupBy("capture").agg(
        part(answer, *[n for n in records.columns if n in ("record_id", "type", "uri", "date", "refers_to", "digest", "payload_bytes", "payload")]).alias("response"),
        part(F.col("type") == "request", "record_id", "uri", "date", "fields").alias("request"),
        part(F.col("type") == "metadata", "record_id", "uri", "date", "fields").alias("metadata"),
    )


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None) -> DataFrame:
    """Write ``pages`` to an archive, read it back, and tell how each page is stored.

    Returns ``id_col`` (as text in the archive, cast back), payload_bytes, payload_digest,
    record_type and refers_to, the id of the page that holds a revisit's payload. Repeated rows
    (same id and payload) are one capture and one row. An empty table gives an empty result;
    further columns are ignored.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archive(pages, path, id_col, url_col, payload_col)
    page = F.regexp_extract("metadata.fields", r"page-id: ([^\r\n]*)", 1)
    kind = pages.schema[id_col].dataType
    found = written(captures(read_records(spark, path, with_payload=False)).select(
        "capture", "response.*", F.when(page != "", page).cast(kind).alias("page")).drop("uri", "date", "payload"))
    stored = found.where("type = 'response'").select(F.col("capture").alias("refers_to"), F.col("page").alias("first"))
    shared = found.where("type = 'revisit'").join(stored, "refers_to", "left")
    alone = found.where("type = 'response'").withColumn("first", F.lit(None).cast(kind))
    columns = [F.col("page").alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("first").alias("refers_to")]
    return alone.select(*columns).unionByName(shared.select(*columns))
