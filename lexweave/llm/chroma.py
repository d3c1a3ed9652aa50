"""Audio fingerprints over pitch classes, and alignment of recordings by them.

A recording becomes frames of FRAME samples every HOP; each frame's power
spectrum is folded into twelve pitch classes and normalised. On the integral
image of (frame, class), FILTERS box filters compare areas; each response is
quantised to two bits (Gray code), and the sixteen responses that begin at a frame make
a packed 32-bit integer.

Two recordings are aligned by the offset at which most of their equal
integers meet; the overlap at this offset is then compared bit by bit, and a share of
unequal bits of at most ``most_errors`` is a match.

Search: recordings with equal fingerprints are one class. The query classes are
written to the folder that executors share. Each task leaves out recordings without
an integer that some query has (a bitmap of bounded size says so), holds at most HELD bytes of the
others, and lets them meet the queries block by block, BLOCK_FRAMES integers at a
time, so neither driver nor plan grow with the queries. ``matches`` gives every pair of a query's
class and a class that aligns with it, its own included, and ``members`` the class of every recording; both together
are every pair of aligning recordings, and copies don't multiply rows. ``search`` is a
report from them: the ``k`` best matches a query and the number of all.

The tables hold no audio, so the registered query takes a recording of each
conversation turn: every word is a chord of two notes, chosen by its hash, HOP samples long.
``pcm16`` reads 16-bit samples from a binary column instead.

Defined results: null and empty recordings have no integers, match nothing and
are returned with nulls; a shorter recording than the widest filter is padded
with silence; matches are ordered by errors, then key; repeated rows match one another; an
empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

RATE = 4000
FRAME = 512
HOP = 256
WIDE = 8
#: Samples decoded at a time (or one longer recording), frames transformed and fingerprints looked at at a time.
SAMPLES = 1 << 21
RECORDINGS = 256
FRAMES = 256
#: Integers of queries that a task looks at at a time, how many such blocks it keeps, and bytes of recordings it holds.
BLOCK_FRAMES = 1 << 18
KEPT_BLOCKS = 4
HELD = 1 << 24
#: About so many matches are held before they are passed on.
MOST_ROWS = 1 << 14
MATCHES = "query_class long, class long, offset long, errors double"
Decoder = Callable[[object], np.ndarray]


def _filters() -> list[list[tuple[int, int, int, int, int]]]:
    """Sixteen filters as boxes (sign, first frame, frames, first class, classes): six shapes at places by rule."""
    out = []
    for i in range(16):
        w, h, y = (WIDE, 4)[i // 6 % 2], (12, 6, 4)[i % 3], 0
        y = (5 * i) % (13 - h)
        shape = i % 6
        if shape == 0:
            boxes = [(1, 0, w // 2, y, h), (-1, w // 2, w - w // 2, y, h)]
        elif shape == 1:
            boxes = [(1, 0, w, y, h // 2), (-1, 0, w, y + h // 2, h - h // 2)]
        elif shape == 2:
            boxes = [(1, 0, w // 2, y, h // 2), (1, w // 2, w // 2, y + h // 2, h // 2), (-1, w // 2, w // 2, y, h // 2), (-1, 0, w // 2, y + h // 2, h // 2)]
        elif shape == 3:
            boxes = [(1, w // 4, w // 2, y, h), (-1, 0, w // 4, y, h), (-1, 3 * w // 4, w // 4, y, h)]
        elif shape == 4:
            boxes = [(1, 0, w, y + h // 4, h // 2), (-1, 0, w, y, h // 4 or 1), (-1, 0, w, y + h // 4 + h // 2, h - h // 4 - h // 2)]
        else:
            boxes = [(1, 0, w, y, max(1, h // 3)), (-1, 0, w, (y + 6) % (13 - max(1, h // 3)), max(1, h // 3))]
        out.append(boxes)
    return out


FILTERS = _filters()
GRAY = np.array([0, 1, 3, 2], np.uint32)


def _bins() -> tuple[np.ndarray, np.ndarray]:
    """The spectrum bins that are heard, by pitch class, and where each class begins among them."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    heard = np.flatnonzero((f > 100) & (f < 1900))
    pitch = np.round(12 * np.log2(f[heard] / 440)).astype(int) % 12
    order = np.argsort(pitch, kind="stable")
    return heard[order], np.searchsorted(pitch[order], np.arange(12))


BINS, FIRST_BIN = _bins()
WINDOW = np.hanning(FRAME).astype(np.float32)


def pitch_classes(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """(frames, 12) of each recording, each frame of sum one, or zero in silence."""
    n = [max(1, -(-(len(r) - FRAME) // HOP) + 1) if len(r) else 0 for r in recordings]
    room = [(k - 1) * HOP + FRAME if k else 0 for k in n]
    padded = np.zeros(max(FRAME, sum(room)), np.float32)
    base = np.cumsum([0, *room])
    for r, at in zip(recordings, base, strict=False):
        padded[at : at + len(r)] = r
    first = np.concatenate([np.arange(k) * HOP + at for k, at in zip(n, base, strict=False)]) if n else np.zeros(0, int)
    windows = np.lib.stride_tricks.sliding_window_view(padded, FRAME)
    out = np.empty((len(first), 12), np.float32)
    for at in range(0, len(first), FRAMES):
        spectrum = np.fft.rfft(windows[first[at : at + FRAMES]] * WINDOW)[:, BINS]
        out[at : at + FRAMES] = np.add.reduceat(spectrum.real**2 + spectrum.imag**2, FIRST_BIN, axis=1)
    total = out.sum(1, keepdims=True)
    out = np.where(total > 1e-9, out / np.maximum(total, 1e-9), 0)
    return np.split(out, np.cumsum(n)[:-1]) if n else []


def packed(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """The integers of each recording's pitch classes, one for each frame at which all filters have room."""
    frames = [max(len(c), WIDE) if len(c) else 0 for c in recordings]
    base = np.cumsum([0, *(n + 1 for n in frames)])
    image = np.zeros((int(base[-1]) + WIDE, 13))  # an integral image for each recording, one below the other
    for classes, n, at in zip(recordings, frames, base, strict=False):
        if n:
            total = classes.cumsum(0, dtype=float).cumsum(1)
            image[at + 1 : at + 1 + len(total), 1:] = total
            image[at + 1 + len(total) : at + 1 + n, 1:] = total[-1]
    rows = int(base[-1])
    place = np.concatenate([np.arange(at, at + n - WIDE + 1) for n, at in zip(frames, base, strict=False) if n]) if any(frames) else np.zeros(0, int)
    out = np.zeros(len(place), np.uint32)
    for boxes in FILTERS:
        area = [np.zeros(rows), np.zeros(rows)]
        for sign, t, w, y, h in boxes:
            area[sign < 0] += image[t + w : t + w + rows, y + h] - image[t : t + rows, y + h] - image[t + w : t + w + rows, y] + image[t : t + rows, y]
        r = np.log((area[0][place] + 0.05) / (area[1][place] + 0.05)).round(6)  # equal areas fall on a threshold whatever was summed before
        out = out << np.uint32(2) | GRAY[(r > -0.6).astype(np.int8) + (r > 0) + (r > 0.6)]
    size = [n - WIDE + 1 if n else 0 for n in frames]
    return np.split(out, np.cumsum(size)[:-1]) if size else []


def pcm16(value: object) -> np.ndarray:
    return np.frombuffer(value or b"", "<i2").astype(np.float32) / 32768


_CHORDS: list[np.ndarray] = []


def sonify(value: object) -> np.ndarray:
    """A chord of two notes for each word."""
    if not _CHORDS:
        t = np.arange(HOP) / RATE
        _CHORDS.append(np.sin(2 * np.pi * 220 * 2 ** (np.arange(24)[:, None] / 12) * t).astype(np.float32))
    h = np.array([zlib.crc32(w.encode()) for w in str(value or "").lower().split()], np.uint32)
    return (_CHORDS[0][h % 24] + 0.7 * _CHORDS[0][(h >> 8) % 24]).ravel()


def fingerprints(rows: DataFrame, key_cols: list[str], media_col: str, decoder: Decoder = pcm16) -> DataFrame:
    """key (struct of the key columns) and fp (binary, packed integers) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heard: list[np.ndarray] = []
            size = 0
            for i, value in enumerate(batch.column(1)):
                heard.append(decoder(value.as_py()))
                size += len(heard[-1])
                if size >= SAMPLES or i + 1 == len(batch):
                    fps = [fp.astype("<u4").tobytes() for fp in packed(pitch_classes(heard))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + 1 - len(heard), len(heard)), pa.array(fps, pa.binary())], names=["key", "fp"])
                    heard, size = [], 0

    key = F.struct(*(F.col(c).cast("long").alias(c) for c in key_cols))
    kind = "struct<" + ",".join(f"{c}:bigint" for c in key_cols) + ">"
    return rows.select(key.alias("key"), F.col(media_col).alias("media")).mapInArrow(run, f"key {kind}, fp binary")


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlap in frames and share of unequal bits where a[i] meets b[i + offset]."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum() / (32 * (hi - lo)))


def members(prints: DataFrame, is_query) -> DataFrame:
    """key, fp, is_query and class of every row of ``prints`` (key, fp); a null class where there are no integers."""
    own = F.when(F.octet_length("fp") > 0, F.xxhash64("fp"))
    return prints.select("key", "fp", is_query.alias("is_query"), own.alias("class"))


class Block:
    """Some queries' integers, ordered, with the query and frame each is from."""

    def __init__(self, names: list[int], fps: list[bytes]):
        self.names = names
        self.fps = [np.frombuffer(f, "<u4") for f in fps]
        size = np.array([len(f) for f in self.fps], np.int64)
        value = np.concatenate(self.fps)
        query = np.repeat(np.arange(len(size), dtype=np.int32), size)
        frame = (np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        order = np.argsort(value, kind="stable")
        self.value, self.query, self.frame = value[order], query[order], frame[order]

    def matches(self, fp: np.ndarray, votes: int, most_errors: float) -> list[tuple[int, int, float]]:
        """(class, offset, errors) of each query that this recording aligns with."""
        lo, hi = np.searchsorted(self.value, fp, "left"), np.searchsorted(self.value, fp, "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            return []
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
        offset = np.repeat(np.arange(len(fp)), n) - self.frame[at]
        pair, count = np.unique((self.query[at].astype(np.int64) << 32) + (offset + (1 << 30)), return_counts=True)
        query = pair >> 32
        order = np.lexsort((pair, -count, query))
        best = order[np.append(True, query[order][1:] != query[order][:-1])]
        out = []
        for k in best.tolist():
            q, off = int(query[k]), int((pair[k] & 0xFFFFFFFF) - (1 << 30))
            own = self.fps[q]
            if count[k] >= min(votes, len(own), len(fp)):
                overlap, errors = align(own, fp, off)
                if errors <= most_errors and 2 * overlap >= min(len(own), len(fp)):
                    out.append((self.names[q], off, errors))
        return out


def matches(placed: DataFrame, votes: int = 3, most_errors: float = 0.25, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """query_class, class, offset and errors of every class that aligns with the class of a query; ``placed``: from ``members``."""
    spark = placed.sparkSession
    classes = common.cut(placed.where(F.col("class").isNotNull()).groupBy("class").agg(F.first("fp").alias("fp"), F.max(F.col("is_query").cast("int")).alias("asks")))
    asking = classes.where("asks = 1").select("class", "fp")
    wanted = spark.sparkContext.broadcast(common.bitmap(asking.mapInArrow(_values, "value long")))
    folder = f"{common.shared_dir(spark).rstrip('/')}/chroma-{uuid.uuid4().hex}"
    asking.write.parquet(folder)
    found = common.cut(classes.select("class", "fp").mapInArrow(_meet(folder, wanted, votes, most_errors, block_frames), MATCHES))
    common.delete(spark, folder)
    return found


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), RECORDINGS):
            values = np.frombuffer(b"".join(batch.column(1).slice(at, RECORDINGS).to_pylist()), "<u4")
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(values).astype(np.int64))], names=["value"])


def _blocks(folder: str, frames: int) -> Iterator[Block]:
    """The queries in the folder, about ``frames`` integers at a time."""
    fs, root = common.file_system(folder)
    names, fps, size = [], [], 0
    for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda i: i.path):
        if not info.base_name.endswith(".parquet"):
            continue
        with fs.open_input_file(info.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(RECORDINGS, columns=["class", "fp"]):
                for name, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    names.append(name)
                    fps.append(fp)
                    size += len(fp) // 4
                    if size >= frames:
                        yield Block(names, fps)
                        names, fps, size = [], [], 0
    if names:
        yield Block(names, fps)


def _meet(folder: str, wanted, votes: int, most_errors: float, frames: int):
    kind = pa.schema([("query_class", pa.int64()), ("class", pa.int64()), ("offset", pa.int64()), ("errors", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        kept: list[Block] = []
        size, known = 0, False
        for part in (b.slice(at, RECORDINGS) for b in batches for at in range(0, len(b), RECORDINGS)):
            names, fps = (c.to_pylist() for c in part.columns)
            length = np.array([len(f) // 4 for f in fps], np.int64)
            there = wanted.value.has(pa.array(np.frombuffer(b"".join(fps), "<u4").astype(np.int64)))
            for i in np.flatnonzero(np.add.reduceat(there, np.cumsum(length) - length)).tolist():
                held.append((names[i], np.frombuffer(fps[i], "<u4")))
                size += len(fps[i])
            if size >= HELD:
                yield from met(held, kept, known)
                held, size, known = [], 0, True
        if held:
            yield from met(held, kept, known)

    def met(held: list[tuple[int, np.ndarray]], kept: list[Block], known: bool) -> Iterator[pa.RecordBatch]:
        """``kept``: the blocks, if they are few; ``known``: whether they have been read before."""
        rows: list[tuple[int, int, int, float]] = []
        for block in kept if known and kept else _blocks(folder, frames):
            if not known:
                kept.append(block)
            for name, fp in held:
                rows += [(q, name, offset, errors) for q, offset, errors in block.matches(fp, votes, most_errors)]
                if len(rows) >= MOST_ROWS:
                    yield batch_of(rows)
                    rows = []
            if len(kept) > KEPT_BLOCKS:
                kept.clear()
                known = True
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    return run


def search(prints: DataFrame, is_query, k: int = 3, votes: int = 3, most_errors: float = 0.25, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """key, n_matches and the k best matches (key, offset, errors) of every query row, itself left out: a report, ``matches`` has all.

    ``prints``: key, fp. n_matches counts the other rows that align, equal recordings included.
    """
    placed = common.cut(members(prints, is_query))
    found = common.cut(matches(placed, votes, most_errors, block_frames))
    sound = placed.where(F.col("class").isNotNull())
    copies = sound.groupBy("class").agg(F.count("*").alias("copies"))
    hits = found.join(copies, "class").groupBy("query_class").agg(F.sum("copies").alias("hits"))
    near = found.join(_few_keys(sound, k + 1), "class").select("query_class", F.explode("keys").alias("key"), "errors", "offset")
    rank = F.row_number().over(Window.partitionBy("query_class").orderBy("errors", "key", "offset"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    best = near.groupBy("query_class").agg(F.sort_array(F.collect_list(F.struct("errors", "key", "offset"))).alias("best"))
    asked = placed.where("is_query").select("key", "class").join(hits.join(best, "query_class").withColumnRenamed("query_class", "class"), "class", "left")
    others = F.slice(F.filter("best", lambda m: m["key"] != F.col("key")), 1, k)
    return asked.select("key", F.greatest(F.coalesce("hits", F.lit(0)) - F.col("class").isNotNull().cast("long"), F.lit(0)).alias("n_matches"), others.alias("best"))


def _few_keys(rows: DataFrame, k: int) -> DataFrame:
    """The k least keys of each class; the limit on the rank also cuts each task's rows before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("class").orderBy("key"))
    few = rows.select("class", "key", rank.alias("rank")).where(F.col("rank") <= k)
    return few.groupBy("class").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def _placed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints(common.table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", sonify)
    return members(prints, F.coalesce(F.col("key.conv_id") % 50 == 0, F.lit(False)))


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every class of turns of conversations whose id is divisible by 50: all classes that align with it, the best first; op6_chroma_members has the turns of a class."""
    found = matches(common.cut(_placed_turns(spark, sf_dir)))
    listed = F.sort_array(F.collect_list(F.struct(F.round("errors", 6).alias("errors"), "class", "offset")))
    return found.groupBy("query_class").agg(F.count("*").alias("n_classes"), F.to_json(listed).alias("classes"))


def op6_chroma_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every turn, null where it has no integers."""
    return _placed_turns(spark, sf_dir).select(F.col("key.conv_id").alias("conv_id"), F.col("key.turn").alias("turn"), "is_query", "class")


def op6_chroma_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on the turns that ask: the three best matches and the number of all."""
    turns = common.table(spark, sf_dir, "conversations")
    prints = fingerprints(turns, ["conv_id", "turn"], "text", sonify)
    got = search(prints, F.coalesce(F.col("key.conv_id") % 50 == 0, F.lit(False)))
    best = F.transform("best", lambda m: F.struct(m["key"]["conv_id"].alias("conv_id"), m["key"]["turn"].alias("turn"), m["offset"].alias("offset"), F.round(m["errors"], 6).alias("errors")))
    return got.select(F.col("key.conv_id").alias("conv_id"), F.col("key.turn").alias("turn"), "n_matches", F.to_json(best).alias("best"))
