"""Document fingerprints by consistent weighted sampling.

A document is a bag of weighted terms: lower-cased neighbouring word pairs
(the first word pairs with the text's start), weighted by how often they
occur. For each of SAMPLES positions every term has fixed random variates
r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), all derived from the term's hash;
with t = floor(ln w / r + b) the term with the least c / exp(r (t - b + 1))
is sampled, and (term, t) is what the signature holds. Two signatures agree at a position
with a probability equal to the documents' generalised Jaccard similarity.
A term is the whole 64-bit hash of its pair, so texts of any length share no
terms but equal ones. The values for weight one, by far the most common, are
kept in a table of 2**CACHE_BITS places a worker, each with the whole hash it
is for; a term that isn't there is computed. Terms are taken SLICE at a time.

The document that follows another in descending id order is found without a
global sort: ids are cut into ranges at approximate quantiles, each range is
sorted by itself, and the head of a range also goes, in the same shuffle, to
the range before it.

Defined results: a null text counts as empty; a text without words has the
empty fingerprint, whose likeness is 1 to another such and 0 to any other;
rows of equal id follow one another in text order; null ids come last; a
single row follows itself; an empty table gives an empty result. Other input
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import word_hashes

SAMPLES = 64
CACHE_BITS = 17
#: Terms handled at a time: SAMPLES numbers are held for each.
SLICE = 4096
#: Terms whose variates are computed at a time: their numbers stay in the processor's cache.
PIECE = 256
#: Characters of text handled at a time.
STEP = 1 << 17
#: Rows of a range, and the most ranges there are: so many numbers go to the driver.
RANGE_ROWS = 1 << 11
MOST_RANGES = 20_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_CACHE: list[np.ndarray] = []


def variates(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each term at each sample, from five times 24 of the 128 bits of two hashes."""
    base = common.mix(terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[:, None] + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    halves = [h for i in (1, 2) for h in _halves(common.mix(base + np.uint64(i * 0x8CB92BA72F3D8DD7 % 2**64)))]
    low = np.uint32(0xFF)
    last = (halves[0] & low) << np.uint32(16) | (halves[1] & low) << np.uint32(8) | halves[2] & low
    u = [((h >> np.uint32(8)).view(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24) for h in halves]
    return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), (last.view(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)


def _weight_one(terms: np.ndarray) -> np.ndarray:
    """The values of terms of weight one at each sample."""
    if not _CACHE:
        known = np.zeros(1 << CACHE_BITS, np.uint64)
        known[0] = np.uint64(0xFFFFFFFFFFFFFFFF)  # an empty place holds a hash that belongs to another
        _CACHE.extend((known, np.empty((1 << CACHE_BITS, SAMPLES), np.float32)))
    known, table = _CACHE
    place = (terms >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
    out = table[place]
    miss = np.flatnonzero(known[place] != terms)
    if len(miss):
        new, inverse = np.unique(terms[miss], return_inverse=True)
        value = np.empty((len(new), SAMPLES), np.float32)
        for at in range(0, len(new), PIECE):
            r, c, b = variates(new[at : at + PIECE])
            value[at : at + PIECE] = c - r * (1 - b)
        out[miss] = value[inverse]
        own, first = np.unique(new >> np.uint64(64 - CACHE_BITS), return_index=True)
        known[own.astype(np.int64)], table[own.astype(np.int64)] = new[first], value[first]
    return out


def _codes(terms: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (common.mix(terms.astype(np.uint64) * np.uint64(0x100000001B3) + np.asarray(t, np.int64).view(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def weighted_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term and weight of every term of every text, by text."""
    w, at = word_hashes([t.lower() if t else t for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    before = np.concatenate([[np.uint64(0)], w[:-1]]) if len(w) else w
    before = np.where(np.append(True, doc[1:] != doc[:-1]) if len(w) else np.zeros(0, bool), np.uint64(0), before)
    pair = common.mix(before * np.uint64(3) ^ w * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))) if len(doc) else order
    return doc[first], pair[first], np.diff(np.append(first, len(doc)))


def signatures(texts: list[str | None]) -> list[np.ndarray | None]:
    """The signature of each text, None without words."""
    doc, term, n = weighted_terms(texts)
    least = np.full((len(texts), SAMPLES), np.inf, np.float32)
    best = np.zeros((len(texts), SAMPLES), np.uint16)
    for at in range(0, len(doc), SLICE):
        d, w, k = doc[at : at + SLICE], term[at : at + SLICE], n[at : at + SLICE]
        value = _weight_one(w)
        t = np.zeros((len(often := np.flatnonzero(k > 1)), SAMPLES), np.float32)
        for i in range(0, len(often), PIECE):
            many = often[i : i + PIECE]
            r, c, b = variates(w[many])
            t[i : i + PIECE] = np.floor(np.log(k[many].astype(np.float32))[:, None] / r + b)
            value[many] = c - r * (t[i : i + PIECE] - b + 1)
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        size = np.diff(np.append(first, len(d)))
        low = np.minimum.reduceat(value, first, axis=0)
        row, sample = np.nonzero(value == np.repeat(low, size, axis=0))
        times = np.zeros(len(row), np.int64)
        counted = np.flatnonzero(k[row] > 1)
        times[counted] = t[np.searchsorted(often, row[counted]), sample[counted]]
        high = np.zeros(low.shape, np.uint16)
        np.maximum.at(high, (np.repeat(np.arange(len(first)), size)[row], sample), _codes(w[row], times))
        own = d[first]
        before = np.where(least[own] <= low, best[own], 0)
        best[own] = np.maximum(before, np.where(low <= least[own], high, 0))
        least[own] = np.minimum(least[own], low)
    there = np.bincount(doc, minlength=len(texts)) > 0
    return [row if k else None for row, k in zip(best, there, strict=True)]


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _text_of(s: np.ndarray | None) -> str:
    return "" if s is None else s.astype(">u2").tobytes().hex()


def _digest(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, each followed by the next."""
    edited = [edit(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    signs = signatures(texts + edited)
    own, changed = signs[: len(texts)], signs[len(texts) :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[: len(edited)], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
            pa.array([_text_of(s) for s in own[:-1]], pa.string()),
            pa.array([_text_of(s) for s in changed], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, members in descending order, then the head of the next range."""
    part, ids, texts, size, closed = None, [], [], 0, False
    for batch in batches:
        for p, member, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if p != part:
                part, ids, texts, size, closed = p, [], [], 0, False
            if closed:
                continue
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            closed = not member
            if len(texts) > 1 and (closed or size > STEP):
                yield _digest(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = max(4 * common.shuffle_width(spark), min(MOST_RANGES, -(-rows.count() // RANGE_ROWS)))
    cuts = rows.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    bounds = -np.array(sorted({int(c) for c in cuts}, reverse=True), np.int64)

    def range_of(ids: pa.Array) -> np.ndarray:
        """Ranges count up as ids go down; ids above the greatest bound are in range 0, nulls in the last."""
        got = np.searchsorted(bounds, -ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
        got[ids.is_null().to_numpy(zero_copy_only=False)] = len(bounds)
        return got

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int | None] = {}
        for batch in batches:
            for p, i in zip(range_of(batch.column(0)).tolist(), batch.column(0).to_pylist(), strict=True):
                if p not in best or (i is not None and (best[p] is None or i > best[p])):
                    best[p] = i
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], names=["part", "top"])

    head = {r["part"]: r["top"] for r in rows.select("doc_id").mapInArrow(tops, "part long, top long").groupBy("part").agg(F.max("top").alias("top")).collect()}
    filled = sorted(head)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = range_of(batch.column(0))
            ids = batch.column(0).to_pylist()
            extra = [k for k, (p, i) in enumerate(zip(parts.tolist(), ids, strict=True)) if i == head[p]]
            member = pa.array([True] * len(ids), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), member, *batch.columns], names=["part", "member", "doc_id", "text"])
            if extra:
                again = batch.take(pa.array(extra))
                yield pa.RecordBatch.from_arrays([pa.array([before[parts[k]] for k in extra], pa.int64()), pa.array([False] * len(extra)), *again.columns], names=["part", "member", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "part long, member boolean, doc_id long, text string")
    walked = dealt.repartition(max(common.shuffle_width(spark), ranges // 4), "part").sortWithinPartitions("part", F.desc("member"), F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    return walked.mapInArrow(_walk, SCHEMA)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(common.table(spark, sf_dir, "documents"))
