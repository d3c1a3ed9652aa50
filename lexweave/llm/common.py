"""Helpers the operators share: tables, checkpoints, byte buffers and counted tables.

Memory rule for the Python side: text is handled in chunks of about
``CHUNK`` bytes however large an Arrow batch is, so a worker's peak follows
the longest single text and never the batch or the partition.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
GAP = 8
#: ASCII letters stay (lowered before), everything else in ASCII becomes a space.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lexweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lost executors cost no recomputation of what lies before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Where a task that reads files itself finds them: any file system that pyarrow knows (local, HDFS, S3, GCS)."""
    if re.match(r"file:/+", path):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def chunks(texts: Iterable[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """(first index, texts) of consecutive runs of at most ``limit`` characters, or of one longer text."""
    start, run, size = 0, [], 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if run and size + n > limit:
            yield start, run
            start, run, size = i, [], 0
        run.append(t)
        size += n
    if run:
        yield start, run


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of lower-cased UTF-8 bytes, ASCII non-letters as spaces, GAP spaces around each text; starts and ends of the texts in it."""
    parts = [(t or "").lower().encode("utf-8", "replace").translate(LETTERS) for t in texts]
    size = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    ends = np.cumsum(size + GAP)
    gap = b" " * GAP
    buf = np.frombuffer(gap + gap.join(parts) + gap, np.uint8)
    return buf, ends - size, ends


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[starts:ends] along axis 0; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    return total[ends] - total[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


TABLE_SCHEMA = "key string, block int, data binary"


def table_rows(counts: dict[str, np.ndarray], block: int = 4096) -> pa.RecordBatch:
    """Counted tables as rows of compressed blocks; blocks of zeros are left out."""
    keys, blocks, data = [], [], []
    for key, arr in counts.items():
        for b in range(0, len(arr), block):
            part = arr[b : b + block]
            if part.any():
                keys.append(key)
                blocks.append(b // block)
                data.append(zlib.compress(part.astype("<i8").tobytes(), 1))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=["key", "block", "data"])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for key, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(zlib.decompress(data), "<i8")
            total[key, block] = total[key, block] + part if (key, block) in total else part
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in total], pa.string()), pa.array([b for _, b in total], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())],
            names=["key", "block", "data"],
        )


def summed_tables(rows: DataFrame, size: int, block: int = 4096) -> dict[str, np.ndarray]:
    """Add up tables of ``size`` counters that tasks have emitted by ``table_rows``.

    The sums run on the executors, block by block, holding one block a key at
    a time; only the totals (``size`` counters a key, whatever the input)
    come to the driver.
    """
    n = max(1, min(shuffle_width(rows.sparkSession), -(-size // block)))
    out: dict[str, np.ndarray] = {}
    for key, b, data in rows.repartition(n, "key", "block").mapInArrow(_sum_blocks, TABLE_SCHEMA).collect():
        arr = out.setdefault(key, np.zeros(size, np.int64))
        part = np.frombuffer(zlib.decompress(bytes(data)), "<i8")
        arr[b * block : b * block + len(part)] += part
    return out


#: A bitmap has at most 2**MOST_BITS bits, 32 MB.
MOST_BITS = 28


@dataclass
class Bitmap:
    """Which hashes occur: never a false no, and a false yes the more often the fuller it is."""

    bits: int
    data: np.ndarray

    def places(self, hashes: pa.Array) -> np.ndarray:
        return (mix(hashes.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, hashes: pa.Array) -> np.ndarray:
        at = self.places(hashes)
        return (self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def bitmap(hashes: DataFrame, bits: int | None = None) -> Bitmap:
    """A bitmap of the only column, longs without nulls; eight bits a row up to 2**MOST_BITS. Tasks send the blocks they have bits in, and these are united block by block."""
    spark = hashes.sparkSession
    if bits is None:
        bits = int(np.clip(np.ceil(np.log2(8 * max(1, hashes.count()))), 12, MOST_BITS))
    wide = min(bits, 17)
    empty = Bitmap(bits, np.zeros(0, np.uint8))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(empty.places(batch.column(0)))
            cuts = np.append(np.flatnonzero(np.append(True, at[1:] >> wide != at[:-1] >> wide)), len(at)) if len(at) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                seen.setdefault(int(at[lo] >> wide), np.zeros(1 << wide, bool))[at[lo:hi] & ((1 << wide) - 1)] = True
        yield blocks({b: np.packbits(x) for b, x in seen.items()})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(zlib.decompress(x), np.uint8)
                seen[b] = seen[b] | part if b in seen else part
        yield blocks(seen)

    def blocks(seen: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in seen.values()], pa.binary())], names=["block", "data"])

    kind = "block int, data binary"
    found = np.zeros(1 << bits - 3, np.uint8)
    for b, x in hashes.mapInArrow(mark, kind).repartition(max(1, min(shuffle_width(spark), 1 << bits - wide)), "block").mapInArrow(unite, kind).collect():
        found[b << wide - 3 : (b + 1) << wide - 3] = np.frombuffer(zlib.decompress(x), np.uint8)
    return Bitmap(bits, found)
