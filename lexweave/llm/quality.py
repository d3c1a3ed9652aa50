"""Quality by importance resampling.

Two generative models over hashed word n-grams (one and two words) are
estimated: one of the target texts (labelled good), one of the raw corpus
(every text). A document's log importance weight is the sum, over all n-grams
of its whole text, of log target probability minus log raw probability.
Weights are tempered by length: a document is drawn as if it had ``NOMINAL``
n-grams of its mean log ratio, or else the longest ones alone would decide.
Adding Gumbel noise drawn from the row key to the tempered log weight and
taking the k largest keys draws k documents without replacement in proportion
to their weights.

Counts cover every row. The models are two tables of ``2**BITS`` counters,
the same size for any input. The k-th largest key is found exactly by
counting keys under ever finer prefixes of their bits, so no sort and no row
goes to the driver.

Defined results: a null or wordless text has no n-grams and weight 0; rows
with an equal key at the threshold are all kept; without target rows every
weight is 0 and the draw is uniform; repeated rows draw equal noise and share
their fate; an empty table gives an empty result. Other input columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 16
#: The length, in n-grams, that every document counts as when it is drawn.
NOMINAL = 256
#: N-grams of ratio 1 added to every mean, so that a text of a few n-grams isn't judged by them alone.
SHORT = 20
SCHEMA = "doc_id long, n_ngrams long, log_weight double, key double, key_order long"
SPACES = bytes(32 if c < 33 else c for c in range(256))
POWER = np.uint64(0x100000001B3)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every white-space word of every text, and where each text's words begin and end (n + 1 places)."""
    parts = [(t or "").encode("utf-8", "replace").translate(SPACES) for t in texts]
    size = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    raw = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    inside = raw != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2] + 1, edge[1::2] + 1
    return span_hashes(raw, begin, end), np.searchsorted(begin, np.concatenate([[0], np.cumsum(size)]) + 1)


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from its bytes taken eight at a time."""
    h = (end - begin).astype(np.uint64)
    if not len(h):
        return h
    longest = int((end - begin).max())
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
    alive = np.arange(len(begin))
    for off in range(0, longest, 8):
        alive = alive[end[alive] - begin[alive] > off]
        at = begin[alive] + off
        value = np.ascontiguousarray(words[at]).view("<u8").ravel()
        left = np.minimum(end[alive] - at, 8).astype(np.uint64)
        value = value & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) * np.uint64(8)))
        h[alive] = common.mix(h[alive] * POWER ^ value)
    return h


def hashed_ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all one- and two-word n-grams, text by text, and the text each belongs to."""
    w, at = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    pair = common.mix(w[:-1] * np.uint64(3) ^ w[1:] * np.uint64(0x9E3779B97F4A7C15))[doc[:-1] == doc[1:]] if len(w) > 1 else w[:0]
    pair_doc = doc[:-1][doc[:-1] == doc[1:]] if len(w) > 1 else doc[:0]
    buckets = np.concatenate([common.mix(w), pair]) >> np.uint64(64 - BITS)
    return buckets.astype(np.int64), np.concatenate([doc, pair_doc])


def labelled(labels: DataFrame, id_col: str, label_col: str, value: int, most: int) -> np.ndarray:
    """Sorted ids labelled ``value``: all of them, or a hash-chosen sample of about ``most``."""
    ids = labels.where(F.col(label_col) == value).select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    n = ids.count()
    if n > most:
        ids = ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return np.sort(np.array([r[0] for r in ids.toLocalIterator()], np.int64))


def among(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, ids)
    return (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == ids) if len(known) else np.zeros(len(ids), bool)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prior: float = 1000.0, max_labels: int = 200_000) -> np.ndarray:
    """Log ratio by bucket. Target: texts labelled 1 (at most about ``max_labels`` of them); raw: every text. ``prior``: n-grams' worth of raw model mixed into the target model."""
    known = docs.sparkSession.sparkContext.broadcast(labelled(labels, id_col, label_col, 1, max_labels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            good = among(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), known.value) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for start, run in common.chunks(batch.column(1).to_pylist()):
                buckets, doc = hashed_ngrams(run)
                raw += np.bincount(buckets, minlength=1 << BITS)
                target += np.bincount(buckets[good[start : start + len(run)][doc]], minlength=1 << BITS)
        yield common.table_rows({"raw": raw, "target": target})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tables = common.summed_tables(rows.mapInArrow(count, common.TABLE_SCHEMA), 1 << BITS)
    zero = np.zeros(1 << BITS, np.int64)
    raw, target = tables.get("raw", zero), tables.get("target", zero)
    if not target.sum():
        return np.zeros(1 << BITS, np.float32)
    q = (raw + 1) / (raw.sum() + (1 << BITS))
    p = (target + prior * q) / (target.sum() + prior)
    return np.log(p / q).astype(np.float32)


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    u = (common.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def keys(id_col: pa.Array, text_col: pa.Array, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of n-grams, log weight and Gumbel key of each row."""
    ids = id_col.fill_null(-1).to_numpy(zero_copy_only=False)
    n, w = np.zeros(len(ids), np.int64), np.zeros(len(ids))
    for start, part in common.chunks(text_col.to_pylist()):
        buckets, doc = hashed_ngrams(part)
        n[start : start + len(part)] = np.bincount(doc, minlength=len(part))
        w[start : start + len(part)] = np.bincount(doc, ratio[buckets], minlength=len(part))
    return n, w, w / (n + SHORT) * NOMINAL + gumbel(ids, seed)


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, n_ngrams, log_weight, Gumbel key, and the key as an integer of the same order, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, w, key = keys(batch.column(0), batch.column(1), shared.value, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(w), pa.array(key), pa.array(ordered(key))], names=["doc_id", "n_ngrams", "log_weight", "key", "key_order"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def ordered(x: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles."""
    i = (x + 0.0).view(np.int64)
    return np.where(i < 0, i ^ np.int64(0x7FFFFFFFFFFFFFFF), i)


def kth_largest(df: DataFrame, col: str, k: int, step: int = 12) -> int:
    """The k-th largest value of a long column, exactly: each pass counts by ``step`` more bits and brings at most 2**step counts to the driver."""
    prefix, known = 0, 0
    while known < 64:
        take = min(step, 64 - known)
        rows = df if not known else df.where(F.shiftright(col, 64 - known) == prefix)
        digit = F.shiftright(col, 64 - known - take)
        counts = rows.groupBy((digit if not known else digit.bitwiseAND(F.lit((1 << take) - 1))).cast("long").alias("digit")).count().collect()
        for b, c in sorted(((r["digit"], r["count"]) for r in counts), reverse=True):
            if k <= c:
                prefix, known = b if not known else prefix << take | b, known + take
                break
            k -= c
        else:
            raise ValueError("k exceeds the number of values")
    return prefix


def resample(docs: DataFrame, ratio: np.ndarray, keep: float, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, n_ngrams, log_weight, key, selected: the ceil(keep * rows) rows with the largest keys are selected."""
    scored = common.cut(weigh(docs, ratio, id_col, text_col, seed))
    n = scored.count()
    k = min(n, math.ceil(keep * n))
    least = kth_largest(scored, "key_order", k) if k else 1 << 63
    chosen = F.col("key_order") >= F.lit(least) if k else F.lit(False)
    return scored.select("doc_id", "n_ngrams", "log_weight", "key", chosen.alias("selected"))


def target_share(labels: DataFrame, label_col: str = "quality") -> float:
    """The share of target rows among the labelled ones; 1 without labels."""
    share = labels.where(F.col(label_col).isNotNull()).agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
    return 1.0 if share is None else share


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    learn = labels.where(common.id_crc("doc_id", 5) != 0)
    return resample(docs, fit(docs, learn), target_share(learn))


def keep_selected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the draw leaves out go; the rest stay as they are."""
    labels = common.table(spark, sf_dir, "labels")
    learn = labels.where(common.id_crc("doc_id", 5) != 0)
    ratio = fit(docs, learn)
    scored = common.cut(weigh(docs, ratio).select("key_order"))
    n = scored.count()
    k = min(n, math.ceil(target_share(learn) * n))
    if not k:
        return docs
    least, at_id, at_text, shared = kth_largest(scored, "key_order", k), docs.columns.index("doc_id"), docs.columns.index("text"), spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, key = keys(batch.column(at_id), batch.column(at_text), shared.value, 1)
            yield batch.filter(pa.array(ordered(key) >= least))

    return docs.mapInArrow(run, docs.schema)
