"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, one learnt from toxic and one from ordinary
texts, give every word of a text a log-likelihood under either class.

Over words: a pair of neighbouring words has a discounted share of what follows its first
word; the rest goes by the second word alone. Only pairs that PAIR_TEXTS
learning texts hold are kept, and what the others had goes to the back-off too, so
probabilities still add up.
Over the bytes of a word: orders ORDER to 2 are counted by class (lower orders by
continuation: in how many different contexts a sequence stands), the lowest
order is counted over both classes together, so what neither class has seen
gets the same probability from both and a rare form of a toxic word is judged
by its stem. A word or pair counts once for each learning text it stands in, and equal
learning texts count once.

What is compared are length-normalised log-likelihoods, toxic less ordinary, a byte:
of the whole text, and of its passages of PASSAGE words, of which the
largest counts and by how much all passages are over SUPPORT together, so a short
abuse in a very long text isn't averaged away. The largest of a single word is taken besides. A logistic
function of these and of the text's length, fitted on learning texts that the models haven't seen,
gives the score.

The models are fitted on a bounded sample: at most about ``max_docs`` texts of
each class, chosen by a hash of the id; so what is broadcast has a bounded
size. All texts are scored whole.

Defined results: a text without a word (null and empty included) has score 0;
without learning rows of both classes every score is 0; null ids are kept and
count as not held out unless crc32('') says so; repeated rows give repeated
results; an empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import among, labelled, span_hashes

ORDER = 8
MASKS = np.array([(1 << 8 * n) - 1 for n in range(ORDER + 1)], np.uint64)
PAIR_TEXTS = 2
#: Words of a passage, and the mean log ratio a byte from which a passage counts as support.
PASSAGE = 2
SUPPORT = 0.25
#: What stands for the word before the first.
START = np.uint64(0x5EED)
EIGHT = np.uint64(8)
EVIDENCE = ("n", "mean", "peak", "support", "worst")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, peak double, mean double"


def grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of letters and word ends in a buffer of words between spaces; at each the last ORDER bytes as a number, cut at the word's start; and how many bytes that are.

    The buffer begins with at least ORDER spaces. A word begins with the space before it.
    """
    space = buf == 32
    at = np.flatnonzero(~space[1:] | ~space[:-1]) + 1
    last = np.maximum.accumulate(np.where(space, np.arange(len(buf)), 0))
    have = np.minimum(at - last[at - 1] + 1, ORDER)
    key = np.zeros(len(at), np.uint64)
    for i in range(ORDER):
        key |= buf[at - i].astype(np.uint64) << np.uint64(8 * i)
    return at, key & MASKS[have], have


class Lookup:
    """Values by 64-bit key: one slot a key in an open table, keys that meet in a slot in a sorted list beside it. Only keys, as packed differences, and values are pickled."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.given = keys, values.astype(np.float32)
        bits = max(4, int(np.ceil(np.log2(2 * max(1, len(keys))))))
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << bits, np.float32)
        _, first = np.unique(slot, return_index=True)
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
        rest = rest[np.argsort(keys[rest], kind="stable")]
        self.more_keys, self.more_values = keys[rest], values[rest].astype(np.float32)

    def __reduce__(self):
        keys, values = self.given
        order = np.argsort(keys, kind="stable")
        steps = np.diff(keys[order], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
        return _unpacked, (zlib.compress(steps.T.tobytes(), 1), zlib.compress(values[order].view(np.uint8).reshape(-1, 4).T.tobytes(), 1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self._slot(keys)
        hit, value = self.keys[slot] == keys, self.values[slot]
        if len(self.more_keys):
            miss = np.flatnonzero(~hit)
            at = np.minimum(np.searchsorted(self.more_keys, keys[miss]), len(self.more_keys) - 1)
            ok = self.more_keys[at] == keys[miss]
            hit[miss[ok]], value[miss[ok]] = True, self.more_values[at[ok]]
        return hit, np.where(hit, value, np.float32(0))


def _unpacked(steps: bytes, values: bytes) -> Lookup:
    keys = np.frombuffer(zlib.decompress(steps), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return Lookup(np.cumsum(keys, dtype=np.uint64), np.frombuffer(zlib.decompress(values), np.uint8).reshape(4, -1).T.copy().view(np.float32).ravel())


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights, len(u))


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def counts_by_order(words: list[bytes], weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Kneser-Ney counts of one class: raw at order ORDER and for sequences that begin a word, else the number of different bytes before a sequence."""
    buf = np.frombuffer(b" " * ORDER + b" ".join(words) + b" ", np.uint8)
    _, key, have = grams(buf)
    weight = np.repeat(weights, [len(w) + 1 for w in words])
    out, above = {}, np.zeros(0, np.uint64)
    for n in range(ORDER, 1, -1):
        own = have == n
        out[n] = _summed(np.concatenate([key[own], above & MASKS[n]]), np.concatenate([weight[own], np.ones(len(above))]))
        above = out[n][0]
    return out


@dataclass
class KneserNey:
    """Log ratios of two classes' probabilities, by sequence and, for unseen ones, by context."""

    seen: dict[int, Lookup] = field(default_factory=dict)
    backoff: dict[int, Lookup] = field(default_factory=dict)
    pairs: Lookup = field(default_factory=lambda: Lookup(np.zeros(0, np.uint64), np.zeros(0)))
    follows: Lookup = field(default_factory=lambda: Lookup(np.zeros(0, np.uint64), np.zeros(0)))

    @classmethod
    def fit(cls, classes: list[dict[int, tuple[np.ndarray, np.ndarray]]], words: list[bytes] | None = None) -> tuple[KneserNey, list[np.ndarray]]:
        """The model over bytes, and the log-likelihoods of ``words`` under either class."""
        model = cls()
        buf = np.frombuffer(b" " * ORDER + b" ".join(words or [b""]) + b" ", np.uint8)
        _, key, have = grams(buf)
        absolute, todo = [np.zeros(len(key)) for _ in classes], np.zeros(len(key), bool)
        levels = {}
        lowest = np.ones(256)
        for counts in classes:
            np.add.at(lowest, (counts[2][0] & MASKS[1]).astype(np.int64), 1)
        lower_keys, lower = np.arange(256, dtype=np.uint64), [lowest / lowest.sum()] * 2
        for n in range(2, ORDER + 1):
            keys = np.union1d(classes[0][n][0], classes[1][n][0])
            contexts = np.unique(keys >> EIGHT)
            now, lam = [], []
            for c, counts in enumerate(classes):
                k, v = counts[n]
                ones, twos = (v == 1).sum(), (v == 2).sum()
                d = ones / (ones + 2 * twos) if ones else 0.5
                h, total = _summed(k >> EIGHT, v)
                _, kinds = _summed(k >> EIGHT, np.ones(len(k)))
                share = d * kinds / total
                base = _find(lower_keys, lower[c], keys & MASKS[n - 1], 1e-9)
                t = _find(h, total, keys >> EIGHT, 0.0)
                own = np.maximum(_find(k, v, keys, 0.0) - d, 0) / np.maximum(t, 1)
                now.append(own + np.where(t > 0, _find(h, share, keys >> EIGHT, 1.0), 1.0) * base)
                lam.append(_find(h, share, contexts, 1.0))
            model.seen[n] = Lookup(keys, np.log(now[0] / now[1]))
            model.backoff[n] = Lookup(contexts, np.log(lam[0] / lam[1]))
            lower_keys, lower = keys, now
            levels[n] = keys, now, contexts, lam
        for n in range(ORDER, 1, -1):
            keys, now, contexts, lam = levels.pop(n)
            todo |= have == n
            here = np.flatnonzero(todo)
            k = key[here] & MASKS[n]
            hit = np.isin(k, keys)
            todo[here[hit]] = False
            for c in range(len(classes)):
                absolute[c][here[hit]] += np.log(_find(keys, now[c], k[hit], 1.0))
                absolute[c][here[~hit]] += np.log(_find(contexts, lam[c], k[~hit] >> EIGHT, 1.0))
        for c in range(len(classes)):
            absolute[c][todo] += np.log(lowest / lowest.sum())[(key[todo] & MASKS[1]).astype(np.int64)]
        first = _begins(buf, *grams(buf)[::2])
        return model, [np.add.reduceat(a, first) if words else np.zeros(0) for a in absolute]

    def add_pairs(self, pair: np.ndarray, before: np.ndarray, counts: list[np.ndarray], totals: list[np.ndarray], discounts: list[float], alone: list[np.ndarray]) -> None:
        """Word pairs: by pair its key, its first word's, its counts, its first word's counts (all pairs'), and the second word's log-likelihood by itself, of each class."""
        contexts, of = np.unique(before, return_inverse=True)
        now, rest = [], []
        for n, total, d, base in zip(counts, totals, discounts, alone, strict=True):
            own = np.maximum(n - d, 0) / np.maximum(total, 1)
            lam = 1 - np.bincount(of, own, len(contexts))
            now.append(own + lam[of] * np.exp(base))
            rest.append(lam)
        self.pairs = Lookup(pair, np.log(now[0] / now[1]))
        self.follows = Lookup(contexts, np.log(rest[0] / rest[1]))

    def ratios(self, key: np.ndarray, have: np.ndarray) -> np.ndarray:
        """Log ratio at each place."""
        out = np.zeros(len(key))
        left = np.arange(len(key))
        for n in range(ORDER, 1, -1):
            here = left[have[left] >= n]
            k = key[here] & MASKS[n]
            hit, value = self.seen[n].get(k)
            out[here[hit]] += value[hit]
            miss = here[~hit]
            out[miss] += self.backoff[n].get(k[~hit] >> EIGHT)[1]
            left = np.concatenate([left[have[left] < n], miss])
        return out


def _begins(buf: np.ndarray, at: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Numbers of the places where words begin."""
    begin = np.flatnonzero(have == 2)
    return begin[buf[at[begin] - 1] == 32]


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return common.mix(before * np.uint64(3) ^ word * np.uint64(0x9E3779B97F4A7C15))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of all words of the texts: buffer, places, grams and their lengths; first place, bytes and end included, hash, hash of the word before, text."""
    buf, lo, _ = common.letters(texts)
    at, key, have = grams(buf)
    begin = _begins(buf, at, have)
    size = np.diff(np.append(begin, len(at)))
    word = span_hashes(buf, at[begin], at[begin] + size - 1)
    doc = np.searchsorted(lo, at[begin], "right") - 1
    before = np.concatenate([[START], word[:-1]]) if len(word) else word
    before = np.where(np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool), START, before)
    return buf, at, key, have, begin, size, word, before, doc


def evidence(model: KneserNey, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Number of words and mean log ratio a byte of each text; of its passages the largest mean and the sum of what is over SUPPORT; the largest mean of a word."""
    _, at, key, have, begin, size, word, before, doc = words_of(texts)
    n, mean, peak, support, worst = (np.zeros(len(texts)) for _ in range(5))
    if not len(at):
        return n, mean, peak, support, worst
    hit, ratio = model.pairs.get(pair_keys(before, word))
    by_bytes = np.add.reduceat(model.ratios(key, have), begin)
    ratio = np.where(hit, ratio, model.follows.get(before)[1] + by_bytes)
    n = np.bincount(doc, minlength=len(texts)).astype(float)
    mean = np.bincount(doc, ratio, len(texts)) / np.maximum(np.bincount(doc, size, len(texts)), 1)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    start = np.maximum(np.arange(len(doc)) - PASSAGE + 1, np.repeat(first, np.diff(np.append(first, len(doc)))))
    total, width = (np.concatenate([[0.0], np.cumsum(x)]) for x in (ratio, size))
    end = np.arange(1, len(doc) + 1)
    passage = (total[end] - total[start]) / (width[end] - width[start])
    peak[doc[first]] = np.maximum.reduceat(passage, first)
    support = np.bincount(doc, np.maximum(passage - SUPPORT, 0), len(texts))
    worst[doc[first]] = np.maximum.reduceat(ratio / size, first)
    return n, mean, peak, support, worst


def _design(n: np.ndarray, mean: np.ndarray, peak: np.ndarray, support: np.ndarray, worst: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(n)), np.clip(mean, -2, 2), peak, np.log1p(n), np.log1p(support), support / np.sqrt(n + 1), worst], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


@dataclass
class ToxicityModel:
    ratios: KneserNey
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, mean, peak, *rest = evidence(self.ratios, texts)
        p = 1 / (1 + np.exp(-np.clip(_design(n, mean, peak, *rest) @ self.weights, -30, 30)))
        return np.where(n > 0, p, 0.0), mean, peak


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, word before, pair, word, 1) for each different pair and, with null keys, each different word of each text."""
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for start, run in common.chunks(batch.column(0).to_pylist()):
            buf, at, _, _, begin, size, word, before, doc = words_of(run)
            raw, place = buf.tobytes(), at[begin]
            label = np.array(labels[start : start + len(run)], np.int64)[doc]
            pair = pair_keys(before, word)
            for keys, paired in ((word, False), (pair, True)):
                once = np.unique(common.mix(keys ^ common.mix(doc)), return_index=True)[1]
                _, some, n = np.unique(common.mix(keys[once] ^ common.mix(label[once])), return_index=True, return_counts=True)
                own = once[some]
                spelt = [raw[place[i] : place[i] + size[i] - 1] for i in own.tolist()]
                none = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[own], pa.int32()), pa.array(before[own].view(np.int64)) if paired else none, pa.array(keys[own].view(np.int64)) if paired else none, pa.array(spelt, pa.binary()), pa.array(n, pa.int64())],
                    names=["label", "before", "pair", "word", "n"],
                )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 8000) -> ToxicityModel | None:
    """Learn from the labelled texts: three quarters of the sample give the counts, the rest the logistic function."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast([labelled(labels, id_col, label_col, c, max_docs) for c in (0, 1)])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            there = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ordinary, toxic = (among(ids, k) & there for k in known.value)
            kept = batch.append_column("label", pa.array(np.where(toxic, 1, 0), pa.int32())).filter(pa.array(ordinary | toxic))
            yield kept.select(["text", "label"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = common.cut(rows.mapInArrow(pick, "text string, label int").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("label").alias("label")))
    counted = F.pmod(F.xxhash64("h"), F.lit(4)) != 0
    rows = common.cut(sample.where(counted).select("text", "label").mapInArrow(_words, "label int, before long, pair long, word binary, n long").groupBy("label", "before", "pair", "word").agg(F.sum("n").alias("n")))
    vocabulary = rows.where("pair IS NULL").select("label", "word", "n").toArrow()
    pairs, totals = _kept_pairs(rows.where("pair IS NOT NULL"))
    words, second = np.unique(np.array(pairs["word"].to_pylist(), object), return_inverse=True) if len(pairs) else ([], [])
    classes = []
    for c in (1, 0):
        own = vocabulary.filter(pa.compute.equal(vocabulary["label"], c))
        if not len(own):
            return None
        classes.append(counts_by_order(own["word"].to_pylist(), own["n"].to_numpy().astype(float)))
    del vocabulary, own
    model, alone = KneserNey.fit(classes, list(words))
    if len(pairs):
        unsigned = [pairs[c].to_numpy().view(np.uint64) for c in ("pair", "before")]
        model.add_pairs(*unsigned, [pairs[f"n{c}"].to_numpy().astype(float) for c in (1, 0)], [pairs[f"total{c}"].to_numpy().astype(float) for c in (1, 0)], totals, [a[second] for a in alone])
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, run in common.chunks(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([*map(pa.array, evidence(shared.value, run)), batch.column(1).slice(start, len(run))], names=[*EVIDENCE, "label"])

    seen = sample.where(~counted).select("text", "label").mapInArrow(measure, "".join(f"{c} double, " for c in EVIDENCE) + "label int").toArrow()
    shared.destroy()
    x = _design(*(seen[c].to_numpy() for c in EVIDENCE))
    y = seen["label"].to_numpy().astype(float)
    ok = x[:, 3] > 0
    if len(set(y[ok])) < 2:
        return ToxicityModel(model, np.array([-4.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0]))
    return ToxicityModel(model, _logistic(x[ok], y[ok]))


def _kept_pairs(pairs: DataFrame) -> tuple[pa.Table, list[float]]:
    """Pairs of PAIR_TEXTS texts and more with their counts (n1, n0) and those of all pairs with their first word (total1, total0); each class's discount."""
    counts = [F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(F.lit(0))).alias(f"n{c}") for c in (1, 0)]
    by_pair = pairs.groupBy("pair", "before").agg(*counts, F.min("word").alias("word"))
    kinds = by_pair.agg(*(F.count_if(F.col(f"n{c}") == k).alias(f"k{c}{k}") for c in (1, 0) for k in (1, 2))).first()
    ones, twos = ([kinds[f"k{c}{k}"] for c in (1, 0)] for k in (1, 2))
    totals = pairs.groupBy("before").agg(*(c.alias(f"total{i}") for c, i in zip(counts, (1, 0), strict=True)))
    kept = by_pair.where(F.col("n1") + F.col("n0") >= PAIR_TEXTS).join(totals, "before")
    return kept.orderBy("pair").toArrow(), [a / (a + 2 * b) if a else 0.5 for a, b in zip(ones, twos, strict=True)]


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p, mean, peak = np.zeros(len(batch)), np.zeros(len(batch)), np.zeros(len(batch))
            for start, part in common.chunks(batch.column(2).to_pylist()) if m else ():
                here = slice(start, start + len(part))
                p[here], mean[here], peak[here] = m.score(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(peak), pa.array(mean)], names=["doc_id", "held_out", "score", "predicted", "peak", "mean"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (common.id_crc(id_col, 4) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels.where(common.id_crc("doc_id", 4) != 2)))
