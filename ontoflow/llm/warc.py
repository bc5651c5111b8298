"""Operator 5: WARC archives, written and read back, with transaction assembly.

Each capture is a request, a response (or a revisit of an earlier payload) and a metadata record. Reading
joins the three through their concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_batches, remove, settle, shared_dir

#: Bytes of a file before compression, about: a reader task holds one file at a time. Pages of one of these classes (bytes of the payload, at most) share files,
#: so that their number bounds a file's size; a longer page's records have files of their own.
FILE_BYTES = 96 << 20
CLASSES = (1 << 17, 1 << 21)
#: Digests of payloads that repeat are broadcast up to so many (about 100 bytes each), and joined by shuffle beyond.
MOST_BROADCAST = 1_000_000
EMPTY_SHA1 = "da39a3ee5e6b4b0d3255bfef95601890afd80709"


def base32_sha1(text: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string's UTF-8 bytes: four characters from each five hex digits."""
    alphabet, digest = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.sha1(text)
    out = []
    for k in range(8):
        v = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(alphabet, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _urn(*parts) -> Column:
    h = F.md5(F.concat_ws(":", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] * (k > 0) + [F.substring(h, a, n)])], F.lit(">"))


def _record(kind: Column, record: Column, media: str, block: Column, *headers: Column | None, date: str) -> Column:
    lines = [F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record), F.lit(f"WARC-Date: {date}"), *headers, F.lit(f"Content-Type: {media}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _header(name: str, value: Column) -> Column:
    """A header line, or null (left out) for a null value."""
    return F.concat(F.lit(f"{name}: "), value)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a request, a response or revisit, and a metadata record for each row into gzipped archives under path.

    Of rows with equal payloads of ``least_bytes`` or more, that with the largest id is the response (of equal
    ids the one read last), others revisit it. A null html is an empty payload, a null url gives no target, a null id
    counts as the smallest. The pages must come in the same order when read again, as files do.
    """
    clean = F.regexp_replace(F.col(url_col), r"[\r\n]+", " ")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), clean.alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), base32_sha1(F.coalesce(F.col(html_col), F.lit(""))).alias("digest"), F.octet_length(F.coalesce(F.col(html_col), F.lit(""))).alias("n"))
    # The rows' numbers must be the same below and in the records, whatever the pages come from.
    pages = settle(pages).withColumn("row", F.monotonically_increasing_id())
    me = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("id"), "row", "page_id")
    same = pages.select("digest", "n", me.alias("me")).filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("me").alias("first"), F.count("*").alias("copies"))
    same = settle(same.filter("copies > 1").select(F.col("digest").alias("_digest"), "first"))
    # Hot payloads are single rows here; the pages' side of a shuffled join can be split.
    same = F.broadcast(same) if same.count() <= MOST_BROADCAST else same
    pages = pages.join(same, (F.col("digest") == F.col("_digest")) & (F.col("n") >= least_bytes), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    page, row = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("row").cast("string")
    response, request, metadata = (_urn(F.lit(k), page, row) for k in ("response", "request", "metadata"))
    refers = F.when(revisit, _urn(F.lit("response"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.col("first.row").cast("string")))
    target, digest = _header("WARC-Target-URI", F.col("url")), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    path_part = F.coalesce(F.nullif(F.regexp_extract(F.col("url"), r"^[^:]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    fields = F.concat_ws("\r\n", _header("pageId", F.col("page_id").cast("string")), F.when(revisit, _header("revisitsPageId", F.col("first.page_id").cast("string"))))
    records = F.array(
        _record(F.lit("request"), request, "application/http; msgtype=request", F.concat(F.lit("GET "), path_part, F.lit(" HTTP/1.1\r\n\r\n")), target, _header("WARC-Concurrent-To", response), date=date),
        _record(F.when(revisit, "revisit").otherwise("response"), response, "application/http; msgtype=response", F.concat(http, F.when(revisit, "").otherwise(F.col("html"))), target, digest, F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), _header("WARC-Refers-To", refers), date=date),
        _record(F.lit("metadata"), metadata, "application/warc-fields", fields, target, _header("WARC-Concurrent-To", response), date=date),
    )
    # A text file's line is a record here, and what ends it is what ends a record.
    rank = F.size(F.filter(F.array(*[F.lit(x) for x in CLASSES]), lambda x: x < F.col("n")))
    for k in sorted(r["k"] for r in pages.select(rank.alias("k")).distinct().collect()):  # len(CLASSES) + 1 numbers at most
        out = pages.filter(rank == k).select(F.explode(records).alias("value"))
        # A page has three records, and only one of them holds the payload.
        most = 3 * max(1, FILE_BYTES // (CLASSES[k] + 4096)) if k < len(CLASSES) else 3
        out.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    if pages.isEmpty():
        pages.selectExpr("'' as value").write.mode("append").text(path)


def _inflate(raw: bytes) -> bytes:
    """A gzip file of any number of members; other bytes as they are."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw))
        raw = d.unused_data.lstrip(b"\0")
    return b"".join(out) if out else raw


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """The headers (names in lower case) and block of each record."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = raw[at:end].decode().split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        if end + 4 + size > len(raw):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, view[end + 4 : end + 4 + size]
        at = end + 8 + size


_RECORD = "record_id string, type string, concurrent_to string, target_uri string, refers_to string, digest string, payload_bytes bigint, fields string, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record; payload_bytes and digest of responses are computed, those of revisits are the headers'."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split(" ") for x in _RECORD.split(", "))])
        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

        for b in batches:
            for file in b.column(0):
                out, held = [], 0
                for h, block in parse(_inflate(file.as_py())):
                    kind, digest, size, fields, payload = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None
                    if kind == "metadata":
                        fields = bytes(block).decode()
                    else:
                        raw = bytes(block)
                        head, _, body = raw.partition(b"\r\n\r\n")
                        if kind == "response":
                            digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
                            payload = body if with_payload else None
                        elif kind == "revisit":
                            size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
                    if held > 16 << 20:
                        yield batch(out)
                        out, held = [], 0
                    held += 1000 + len(payload or b"")
                    out.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, fields, payload))
                yield batch(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.transform(map_batches, rows, _RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, target_uri, response, request, metadata; a missing request or metadata record is null.

    Several requests or metadata records of one capture give a row for each combination, as the records say.
    """
    nest = ["record_id", "target_uri", "refers_to", "type", "digest", "payload_bytes", "payload"]
    response = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("_id"), F.struct(*nest).alias("response"))
    request = records.filter("type = 'request'").select(F.col("concurrent_to").alias("_id"), F.struct("record_id", "target_uri").alias("request"))
    metadata = records.filter("type = 'metadata'").select(F.col("concurrent_to").alias("_id"), F.struct("record_id", "fields").alias("metadata"))
    joined = response.join(request, "_id", "left").join(metadata, "_id", "left")
    field = lambda name: F.nullif(F.regexp_extract("metadata.fields", rf"(?m)^{name}: (-?\d+)\r?$", 1), F.lit("")).cast("long")
    return joined.select(field("pageId").alias("page_id"), field("revisitsPageId").alias("refers_to_page"), F.col("response.target_uri").alias("target_uri"), "response", "request", "metadata")


def round_trip(pages: DataFrame, least_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write the pages' archives into the shared folder, read them back and assemble captures; the archives are removed again."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least_bytes=least_bytes)
    records = settle(read_records(spark, path, with_payload))
    remove(spark, path)
    return captures(records)


def digests(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of captures."""
    kind = F.col("response.type")
    return found.select("page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), kind.alias("record_type"), F.when(kind == "revisit", F.col("refers_to_page")).alias("refers_to"))
