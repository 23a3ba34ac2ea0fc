"""WARC archives: records written by Spark, read back, and assembled into one nested row per capture.

A capture is a request, a response or revisit, and a metadata record; request
and metadata name the response in WARC-Concurrent-To.  Records are UTF-8 text
whose terminator is the text writer's line separator, so the archives can lie in
any file system that Spark writes to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this size are never revisits.
LEAST_REVISIT = 1000
#: Payload bytes up to which so many records share a file; a file is read as one row, so larger payloads have fewer neighbours and the largest none.
FILES = ((1 << 16, 3000), (1 << 22, 48), (1 << 62, 3))
_END = "\r\n\r\n"
RECORD = "type string, id string, concurrent_to string, refers_to string, uri string, date string, digest string, head string, fields string, payload binary, payload_bytes long"


def _uuid(kind: str, key: str = "key", url: str = "url") -> Column:
    """A name-based identifier of a capture's record, from its key, URL and payload digest: the same capture has the same one in every run."""
    own = F.concat_ws("\n", F.lit(kind), F.col(key).cast("string"), F.col(url), F.col("digest"))
    h = F.md5(own.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _base32(hex40: Column) -> Column:
    """A SHA-1 in hexadecimal as the 32 characters that WARC-Payload-Digest carries: five digits make four characters."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """The record without its terminator; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v) for name, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(_END), block)


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``key, url, payload, digest, refers_to``: of equal payloads of LEAST_REVISIT bytes or more, all but that of the largest key, then URL, name its key and URL.

    Payloads meet by digest and length only where a digest repeats, and the
    payload's own rows move once.
    """
    rows = pages.select(F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20]", "%20").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload")})
    first = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max(F.struct("key", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = rows.join(first, ["digest", "size"], "left")
    return met.select("key", "url", "payload", "digest", F.when(F.struct("key", "url") < F.col("first"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write three records for every row of ``pages`` to gzip archives under ``path``; null payloads are empty, null keys are left out.

    Rows that repeat a key are captures of their own unless URL and payload are
    equal too: such rows give equal records, which count once when read.  Pages
    of very different sizes are written to files of their own, so that no
    archive holds much more than 200 MB or one capture.  Other columns are ignored.
    """
    pages = pages.where(F.col(key).isNotNull())
    size = F.coalesce(F.octet_length(F.col(payload)), F.lit(0))
    shelf = F.lit(len(FILES) - 1)
    for i in reversed(range(len(FILES) - 1)):
        shelf = F.when(size <= FILES[i][0], i).otherwise(shelf)
    there = {r[0] for r in pages.select(shelf.cast("int")).distinct().collect()}
    for i, (_, records) in enumerate(FILES):
        if i in there or (i == 0 and not there):
            _write(planned(pages.where(shelf == i), key, url, payload), path, date, records)


def _write(rows: DataFrame, path: str, date: str, most: int) -> None:
    answer = _uuid("response")
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", date)]
    digest = F.concat(F.lit("sha1:"), _base32(F.col("digest")))
    head = F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{_END}")
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _uuid("request")), ("WARC-Concurrent-To", answer), *common, ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END)))
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", answer), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], F.concat(head, F.col("payload")))
    revisit = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", answer), ("WARC-Refers-To", _uuid("response", "refers_to.key", "refers_to.url")), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response")], head)
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _uuid("metadata")), ("WARC-Concurrent-To", answer), *common, ("Content-Type", "application/warc-fields")], F.concat(F.lit("capture: "), F.col("key").cast("string"), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(request, F.when(F.col("refers_to").isNotNull(), revisit).otherwise(response), metadata)).alias("value"))
    records.write.mode("append").option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _records(data: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an archive, one after another."""
    while True:
        line = data.readline()
        while line in (b"\r\n", b"\n"):
            line = data.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = data.read(int(headers["content-length"]))
        kind = headers.get("content-type", "")
        http, payload = block.split(b"\r\n\r\n", 1) if kind.startswith("application/http") and b"\r\n\r\n" in block else (b"", block)
        digest = headers.get("warc-payload-digest", "").partition(":")[2]
        fields = kind.startswith("application/warc-fields")
        whole = None if fields or headers.get("warc-type") == "revisit" else payload
        found = hashlib.sha1(whole).hexdigest() if whole is not None else None
        stated = base64.b32decode(digest).hex() if digest else None
        if found and stated and found != stated:
            raise ValueError(f"payload of {headers.get('warc-record-id')} does not have its digest")
        yield {
            "type": headers.get("warc-type"), "id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"),
            "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "digest": found or stated,
            "head": http.decode("utf-8", "replace"), "fields": block.decode("utf-8", "replace") if fields else None, "payload": whole,
            "payload_bytes": None if whole is None else len(whole),
        }


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, columns as in RECORD; plain and gzip archives of other writers can be read too."""
    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in RECORD.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                data = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                held, size = [], 0
                for r in _records(data):
                    held.append(r)
                    size += len(r["payload"] or b"")
                    if size > 1 << 22 or len(held) >= 2000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def captures(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per capture: ``id, uri, date, type, digest, payload_bytes, request, response, metadata, refers_to``.

    Request and metadata join their response through WARC-Concurrent-To and are
    null where absent.  A revisit's ``payload_bytes`` are those of the record
    that it refers to.  Records that occur twice count once.
    """
    payload = F.col("payload") if with_payload else F.lit(None).cast("binary")
    answers = records.where("type in ('response', 'revisit')").select("id", "uri", "date", "type", "digest", "refers_to", F.struct("head", payload.alias("payload")).alias("response"), F.col("payload_bytes").alias("own_bytes")).dropDuplicates(["id"])
    asked = records.where("type = 'request'").select(F.col("concurrent_to").alias("id"), F.struct(F.col("id").alias("id"), "head").alias("request")).dropDuplicates(["id"])
    said = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct(F.col("id").alias("id"), "fields").alias("metadata")).dropDuplicates(["id"])
    # Responses look for themselves here, so that rows without a reference spread over all tasks.
    sizes = answers.where("type = 'response'").select(F.col("id").alias("first"), F.col("own_bytes").alias("first_bytes"))
    whole = answers.withColumn("first", F.coalesce("refers_to", "id")).join(asked, "id", "left").join(said, "id", "left").join(sizes, "first", "left")
    return whole.select("id", "uri", "date", "type", "digest", F.coalesce("own_bytes", "first_bytes").alias("payload_bytes"), "request", "response", "metadata", "refers_to")
