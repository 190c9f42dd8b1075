"""Write pages as a deduplicated WARC archive and read it back.

Revisit resolution: headers (digest, length, id, address) are shuffled by payload digest; the record with the largest
id of each group of equal payloads is the response and every other one is a revisit that names it, with fresh
headers and no payload.  Revisit records are made of headers alone.  Responses are the pages whose (id, digest) is not a revisit's: up to ``BROADCAST``
revisits these keys are sent to the pages, and no payload is moved; beyond, pages are shuffled once to meet them.

Archives are gzip files by Spark's text writer, whose line separator is WARC's end-of-record mark.  Pages are written by classes of size (powers of 8), a job a
class that occurs, with as many records a file as hold ``FILE_BYTES`` if all are as large as the class allows: no file is larger, wherever large
pages stand, but for one of a single page.  Each file is read back in a stream, record by record, by Content-Length, and every payload's digest is verified.

Cases:  null html is an empty payload; a null url writes no target line; rows that repeat the largest id of a
group are all written as responses; a null id counts as smaller than any other, and rows that only have null ids are responses; rows that repeat id, address and payload have one
record id, all others their own; an empty table gives an empty archive; a very large page is held by one task, on its own and compressed with its file;
ids are cast to long; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved, scratch, text_of

END = "\r\n\r\n"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, url string, record_id string, refers_to_record string"
BROADCAST, FILE_BYTES, MOST = 500_000, 128 << 20, 20_000
LEAST_CLASS, HEAD_BYTES = 3, 2_048
"""Pages below 8^4 bytes are one class of size; bytes of headers, as far as addresses are not longer."""
PIECE = 1 << 18
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: five hex digits are four base-32 digits, and 160 bits need no padding."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, bytes and digest of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of(F.col("html")).alias("payload"))
    return rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.encode("payload", "UTF-8"))})


def revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Of (page_id, url, bytes, digest) those rows that revisit an earlier original, with ``original`` (id) and ``original_url``."""
    rows = headers.where(F.col("bytes") >= least_bytes)
    top = rows.where("page_id is not null").groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("rows"))
    nulls = rows.where("page_id is null").select("digest", "bytes").distinct().withColumn("null_too", F.lit(True))
    top = top.join(nulls, ["digest", "bytes"], "left").where("rows > 1 or null_too")
    joined = rows.join(top.select("digest", "bytes", "top"), ["digest", "bytes"])
    found = joined.where(F.col("page_id").isNull() | (F.col("page_id") < F.col("top.page_id")))
    return found.select("page_id", "url", "bytes", "digest", F.col("top.page_id").alias("original"), F.col("top.url").alias("original_url"))


def record_id(kind: str, page_id: Column, digest: Column, url: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in (page_id, digest, url)]
    key = F.md5(F.concat_ws(" ", F.lit(kind), *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def _head(kind: str, date: str, more: list[Column]) -> Column:
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.lit(kind)),
        _line("WARC-Record-ID", record_id(kind, F.col("page_id"), F.col("digest"), F.col("url"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("X-Payload-Length", F.col("bytes").cast("string")),
        *more,
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = MOST, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write gzip-compressed archives below ``path``; ``date`` is that of all records, now by default."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = payloads(pages)
    headers = saved(rows.drop("payload"), "warc-headers")
    again = saved(revisits(headers, least_bytes), "warc-revisits")
    keys = again.select("page_id", "digest").distinct()
    if again.count() <= BROADCAST:  # some 60 bytes a row
        keys = F.broadcast(keys)
    keys = keys.withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    known = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    body = [_line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("bytes").cast("string"))]
    responses = rows.join(keys, known, "left_anti")
    named = [
        _line("WARC-Profile", F.lit(REVISIT)), _line("WARC-Refers-To", record_id("response", F.col("original"), F.col("digest"), F.col("original_url"))),
        _line("X-Refers-To-Page-ID", F.col("original").cast("string")), _line("Content-Length", F.lit("0")),
    ]
    # Pages of one class of size at a time, so that a number of records bounds the bytes of a file, wherever large pages stand.
    classes = [r.c for r in headers.select(_class(F.col("bytes")).alias("c")).distinct().orderBy("c").collect()]  # a number a power of 8
    for c in classes:
        own = responses.where(_class(F.octet_length("payload")) == c).select(F.concat(_head("response", date, body), F.col("payload")).alias("record"))
        _write(own, path, min(records_per_file, file_bytes // (8 ** (c + 1) + HEAD_BYTES)))
    _write(again.select(_head("revisit", date, named).alias("record")), path, min(records_per_file, file_bytes // HEAD_BYTES))


def _class(size: Column) -> Column:
    """The power of 8 that a size is at or above, 512 at least."""
    found = F.lit(LEAST_CLASS)
    for power in range(LEAST_CLASS + 1, 11):
        found = F.when(size >= 8**power, F.lit(power)).otherwise(found)
    return found


def _write(records: DataFrame, path: str, most: int) -> None:
    out = records.write.mode("append").option("lineSep", END).option("compression", "gzip")
    out.option("maxRecordsPerFile", max(1, most)).text(path)


class Stream:
    """The inflated bytes of a gzip file of one or more members, a piece at a time."""

    def __init__(self, packed: bytes) -> None:
        self.packed, self.at, self.inflate, self.ready = packed, 0, zlib.decompressobj(wbits=31), bytearray()

    def more(self) -> bool:
        """Inflate a piece; false at the end."""
        if self.at >= len(self.packed):
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(wbits=31)
        piece = self.packed[self.at : self.at + PIECE]
        self.ready += self.inflate.decompress(piece)
        self.at += len(piece) - len(self.inflate.unused_data)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``; none at the end."""
        seen = 0
        while (stop := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            if not self.more():
                if self.ready:
                    raise ValueError("an archive ends inside a record")
                return None
        found = bytes(self.ready[:stop])
        del self.ready[: stop + len(mark)]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if not self.ready and not self.more():
                raise ValueError("an archive ends inside a record")
            piece = bytes(self.ready[:n])
            del self.ready[: len(piece)]
            n -= len(piece)
            if piece:
                yield piece


def parse(packed: bytes, bodies: bool = True) -> Iterator[tuple]:
    """Records of one gzip file, in ``ROWS``: the body's length is Content-Length, whatever it contains."""
    import base64
    import hashlib

    stream, mark = Stream(packed), END.encode()
    while (top := stream.until(mark)) is not None:
        head = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
        kind, page, sha1, body = head["WARC-Type"], head.get("X-Page-ID"), hashlib.sha1(), bytearray()
        for piece in stream.pieces(int(head["Content-Length"])):
            sha1.update(piece)
            if bodies:
                body += piece
        if stream.until(mark) != b"":
            raise ValueError(f"record {page}: no end mark")
        digest, refers = head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("X-Refers-To-Page-ID")
        if kind == "response" and base64.b32encode(sha1.digest()).decode() != digest:
            raise ValueError(f"payload of record {page} does not match its digest")
        yield (
            None if page is None else int(page), int(head["X-Payload-Length"]), digest, kind, None if refers is None else int(refers),
            bytes(body) if kind == "response" and bodies else None, head.get("WARC-Target-URI"), head["WARC-Record-ID"], head.get("WARC-Refers-To"),
        )


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of ``ROWS``; a revisit has no payload of its own.  The digest of every payload is verified."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in ROWS.split(", ")]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found, size = [], 0
                for record in parse(content.as_py(), payloads):
                    found.append(record)
                    size += 256 + len(record[5] or b"")
                    if size >= FILE_BYTES // 4:
                        yield batch_of(found)
                        found, size = [], 0
                yield batch_of(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(rows, ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h,
        list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest
      FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS original FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < original THEN original END AS refers_to
FROM m
"""
