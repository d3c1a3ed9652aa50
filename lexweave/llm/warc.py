"""WARC archives: a Python data source that reads them and a Spark writer.

Reading plans one partition for each file (small files share one). Of each
record the headers are parsed first; predicates on the record type and on
header columns that Spark pushes down are decided on them alone, and the block of
a record that fails is skipped by seeking (or, in compressed files,
discarded), never decoded. Option ``payload`` = false leaves the payload
column null; option ``verify`` = true checks each response's payload against
its digest and fails on a mismatch.

Writing builds one record a row as a string and lets Spark's text writer put
the record separator, CRLF CRLF, between them, so archives can go to any file
system that Spark writes to, task by task with Spark's commit protocol.
Of records with equal payloads of at least ``revisit_bytes``, the one
with the largest key is a response and the others are revisits of it. Which
ones are equal is found from keys and digests alone. Rows whose digest surely
stands alone are written where they are read; only the others meet their
group, and of these surely none but the responses take their payload along
(two bitmaps of bounded size say so; they never miss a row).

Defined results: a null payload is empty; null target URIs and keys leave their header out
and come back null; equal payloads under one and the same largest key are all responses, as are
those whose keys are all null; control characters in a header value are percent-encoded; a missing length, a
cut-off record, a missing type, an HTTP block without an empty line or a digest that doesn't fit raises ValueError, whatever is read of the record; an empty table gives an archive without
records. Other input columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith

from . import common

SEPARATOR = "\r\n\r\n"
KEY = "X-Row-Key"
LENGTH = "X-Payload-Length"
SCHEMA = "file string, offset long, record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
TESTS = {
    EqualTo: lambda f, v: v is not None and v == f.value,
    EqualNullSafe: lambda f, v: v == f.value,
    In: lambda f, v: v is not None and v in f.value,
    IsNull: lambda f, v: v is None,
    IsNotNull: lambda f, v: v is not None,
    StringStartsWith: lambda f, v: v is not None and v.startswith(f.value),
    StringEndsWith: lambda f, v: v is not None and v.endswith(f.value),
    StringContains: lambda f, v: v is not None and f.value in v,
}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.group_bytes = int(options.get("group_bytes", 32 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = common.file_system(self.path)
        found = fs.get_file_info(root)
        if found.type == pafs.FileType.Directory:
            infos = [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))]
        elif found.type == pafs.FileType.File:
            infos = [found]
        else:
            raise FileNotFoundError(self.path)
        groups: list[Files] = []
        room = 0
        for i in sorted(infos, key=lambda i: i.path):
            if not groups or i.size > room:
                groups.append(Files([]))
                room = self.group_bytes
            groups[-1].paths.append(i.path)
            room -= i.size
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = common.file_system(self.path)
        for path in partition.paths:
            yield from self._batches(fs, path)

    def _batches(self, fs: pafs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._records(fs, path):
            rows.append(row)
            size += len(row[-1] or b"") + 500
            if size > self.batch_bytes:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, fs: pafs.FileSystem, path: str) -> Iterator[tuple]:
        packed = path.endswith(".gz")
        with fs.open_input_file(path) as raw, gzip.GzipFile(fileobj=raw) if packed else raw as f:
            head = _Buffered(f, None if packed else raw.size())
            while (record := head.headers()) is not None:
                at, headers = record
                if "content-length" not in headers:
                    raise ValueError(f"{path}: a record at {at} has no length")
                if "warc-type" not in headers:
                    raise ValueError(f"{path}: a record at {at} has no type")
                length = int(headers["content-length"])
                if not all(TESTS[type(x)](x, headers.get(HEADER_OF[x.attribute[0]])) for x in self.filters):
                    head.skip(length)
                    continue
                http = "application/http" in headers.get("content-type", "")
                payload, body = None, length
                full = headers["warc-type"] == "response"
                if self.payload or (self.verify and full):
                    block = head.take(length)
                    payload = _payload(block) if http else block
                    body = len(payload)
                elif http:
                    body -= head.http(length)
                else:
                    head.skip(length)
                digest = headers.get("warc-payload-digest")
                if self.verify and full and digest and digest.lower().startswith("sha1:") and digest[5:] != digest_of(payload):
                    raise ValueError(f"{path}: the payload at {at} doesn't fit its digest")
                yield (
                    path, at, headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-date"), digest, headers.get("warc-refers-to"),
                    body if full else int(headers[LENGTH.lower()]) if LENGTH.lower() in headers else None, list(headers.items()), payload if self.payload else None,
                )


def _payload(block: bytes) -> bytes:
    head, empty, payload = block.partition(b"\r\n\r\n")
    if not empty:
        raise ValueError("an HTTP block has no empty line")
    return payload


class _Buffered:
    """A forward reader that knows where records begin; ``size`` of the file where it can be sought in."""

    def __init__(self, f, size: int | None = None):
        self.f, self.size, self.buf, self.at, self.base = f, size, b"", 0, 0

    def _read(self, n: int) -> bytes:
        try:
            return self.f.read(n)
        except EOFError as e:
            raise ValueError("a record is cut off") from e

    def _more(self) -> bool:
        got = self._read(1 << 18)
        self.buf, self.base, self.at = self.buf[self.at :] + got, self.base + self.at, 0
        return bool(got)

    def _until(self, mark: bytes) -> bytes | None:
        while (end := self.buf.find(mark, self.at)) < 0:
            if not self._more():
                return None
        out, self.at = self.buf[self.at : end], end + len(mark)
        return out

    def headers(self) -> tuple[int, dict[str, str]] | None:
        while True:
            while self.at < len(self.buf) and self.buf[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.buf):
                break
            if not self._more():
                return None
        start = self.base + self.at
        text = self._until(b"\r\n\r\n")
        if text is None or not text.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {start}")
        lines = re.sub(r"\r\n[ \t]+", " ", text.decode("utf-8", "replace")).split("\r\n")[1:]
        return start, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def take(self, n: int) -> bytes:
        parts = [self.buf[self.at : self.at + n]]
        self.at += len(parts[0])
        left = n - len(parts[0])
        if left:
            self.base, self.buf, self.at = self.base + self.at + left, b"", 0
            parts.append(self._read(left))
            if len(parts[-1]) < left:
                raise ValueError("a record is cut off")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        here = min(n, len(self.buf) - self.at)
        self.at += here
        left = n - here
        if not left:
            return
        self.base, self.buf, self.at = self.base + self.at + left, b"", 0
        if self.size is not None:
            if self.base > self.size:
                raise ValueError("a record is cut off")
            self.f.seek(left, 1)
            return
        while left:
            got = len(self._read(min(left, 1 << 20)))
            if not got:
                raise ValueError("a record is cut off")
            left -= got

    def http(self, n: int) -> int:
        """Skip a block of n bytes that begins with an HTTP head; the head's length."""
        while (end := self.buf.find(b"\r\n\r\n", self.at, self.at + n)) < 0:
            if len(self.buf) - self.at >= n:
                raise ValueError("an HTTP block has no empty line")
            if not self._more():
                raise ValueError("a record is cut off")
        head = end + 4 - self.at
        self.skip(n)
        return head


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    s, n = pa.string(), pa.int64()
    kinds = [s, n, s, s, s, s, s, s, n, pa.map_(s, s), pa.binary()]
    names = ["file", "offset", "record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "payload_length", "headers", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(path)


def base32_sha1(payload: Column) -> Column:
    """The bare base32 SHA-1 of a string's UTF-8: twenty bits, five hexadecimal digits, at a time."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _safe(value: Column) -> Column:
    """Control characters percent-encoded."""
    out = value
    for c in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(value.rlike(r"[\x00-\x1f\x7f]"), out).otherwise(value)


def _record(date: str) -> Column:
    """The text of a record from key, uri, payload, digest, size and origin (null for responses)."""
    origin, key = F.col("origin"), F.col("key").cast("string")
    full = origin.isNull()
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(SEPARATOR))
    lines = [
        F.lit("WARC/1.1"),
        F.when(full, F.lit("WARC-Type: response")).otherwise(F.lit("WARC-Type: revisit")),
        F.coalesce(F.concat(F.lit("WARC-Record-ID: <urn:row:"), key, F.lit(">")), F.concat(F.lit("WARC-Record-ID: <urn:digest:"), F.col("digest"), F.lit(">"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _safe(F.col("uri"))),
        F.concat(F.lit(f"{KEY}: "), key),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit(f"{LENGTH}: "), F.col("size").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.when(~full, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:row:"), origin.cast("string"), F.lit(">")),
        F.concat(F.lit("Content-Length: "), (F.octet_length(block) + F.when(full, F.col("size")).otherwise(F.lit(0))).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(SEPARATOR), block, F.when(full, F.col("payload")).otherwise(F.lit("")))


def write_warc(rows: DataFrame, path: str, key_col: str, uri_col: str, payload_col: str, revisit_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", compression: str = "none") -> None:
    """One response or revisit record for each row."""
    spark = rows.sparkSession
    plain = rows.select(F.col(key_col).cast("long").alias("key"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    hashed = plain.select("key", "uri", "payload", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    light = common.cut(hashed.select("key", "digest", "size", F.xxhash64("digest").alias("same"), F.xxhash64("digest", "key").alias("own")))
    groups = light.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("key").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top", F.lit(True).alias("repeated"))
    repeated = common.cut(groups)
    shared = spark.sparkContext.broadcast(common.bitmap(repeated.select(F.xxhash64("digest"))))
    origin = F.when(F.col("key").eqNullSafe(F.col("top")), None).otherwise(F.col("top")).alias("origin")

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column(2))))

    maybe = light.select("key", "digest", "same", "own").mapInArrow(among, "key long, digest string, same long, own long")
    first = maybe.join(repeated, "digest", "left").select("own", origin).where("origin IS NULL").select("own")
    keepers = spark.sparkContext.broadcast(common.bitmap(common.cut(first)))

    def parted(crowded: bool) -> DataFrame:
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (batch.slice(at, 256) for batch in batches for at in range(0, len(batch), 256)):
                out = part.filter(pa.array(shared.value.has(part.column("same")) == crowded))
                if crowded and len(out):
                    kept = pc.if_else(pa.array(keepers.value.has(out.column("own"))), out.column("payload"), pa.scalar(None, pa.string()))
                    out = out.set_column(out.schema.get_field_index("payload"), "payload", kept)
                if len(out):
                    yield out.select(["key", "uri", "payload", "digest", "size"])

        named = hashed.select("*", F.xxhash64("digest").alias("same"), F.xxhash64("digest", "key").alias("own"))
        return named.mapInArrow(pick, "key long, uri string, payload string, digest string, size long")

    alone = parted(False).withColumn("origin", F.lit(None).cast("long"))
    grouped = parted(True).join(repeated, "digest", "left").select("key", "uri", "payload", "digest", "size", origin)
    records = alone.unionByName(grouped).select(_record(date).alias("value"))
    records.write.option("lineSep", SEPARATOR).option("compression", compression).text(path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, which are held against their digests; revisits by their headers alone."""
    path = f"{common.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(common.table(spark, sf_dir, "pages"), path, "page_id", "url", "html", compression="gzip")
    full = read_warc(spark, path, payload="false", verify="true").where("record_type = 'response'")
    again = read_warc(spark, path, payload="false").where("record_type = 'revisit'")
    got = full.unionByName(again).select(
        F.col("headers")[KEY.lower()].cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to") != "", F.regexp_extract("refers_to", r"<urn:row:(-?\d+)>", 1)).cast("long").alias("refers_to"),
    )
    kept = common.cut(got)
    common.delete(spark, path)
    return kept
