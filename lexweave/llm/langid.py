"""Language identification by error-correcting output codes.

Every language has a binary codeword. One binary n-gram classifier per bit
tells the languages whose codeword has the bit from the others: a hashed
byte-n-gram model whose weight for an n-gram is the log ratio of the mean
class-conditional probabilities on either side. A text's margin on a bit is
the mean weight over all n-grams of the whole text. Decoding is
loss-weighted: each (language, bit) pair weighs as much as that bit's
classifier was right on that language, and the codeword with the least
weighted logistic loss wins. A text whose two best codewords lie closer than
``ambiguity`` is flagged.

Counts come from every learning row but those of a hash-chosen sample of about
``calibration_rows`` (a fifth of the rows at most), on which bit accuracies and
margin scales are measured. What is broadcast is the
weight table, ``2**BITS`` rows by code length, of the same size for any input:
the ``max_langs`` languages with most rows are learnt.

Defined results: a null text, or one without any letter, is ``und`` with score
0; with no learning rows every text is ``und``; null ids are kept and count as
held out (crc32 of the empty text); repeated rows give repeated results; an
empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 16
ORDER = 4
UND = "und"
LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, margin double"


def ngrams(buf: np.ndarray) -> np.ndarray:
    """Hash of the ORDER bytes that begin at each place."""
    b = buf.astype(np.uint32)
    k = b[:-3] | (b[1:-2] << 8) | (b[2:-1] << 16) | (b[3:] << 24)
    k *= np.uint32(0x9E3779B1)
    k ^= k >> np.uint32(15)
    k *= np.uint32(0x85EBCA77)
    return (k >> np.uint32(32 - BITS)).astype(np.int32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1: the exhaustive code up to 7 languages, then the random dense code with the largest least distance of 200 draws."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        cols = [[1, *(1 if c >> i & 1 else -1 for i in range(n - 1))] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols, np.int8).T
    width, rng, best = math.ceil(10 * math.log2(n)), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
        if (least := int(apart[np.triu_indices(n, 1)].min())) > best[0]:
            best = least, code
    return best[1]


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str | None]) -> np.ndarray:
        buf, starts, ends = common.letters(texts)
        h = ngrams(buf)
        blank = int(ngrams(np.full(4, 32, np.uint8))[0])
        real = (h != blank).astype(np.float32)
        lo, hi = np.maximum(starts - (ORDER - 1), 0), np.minimum(ends, len(h))
        n = common.segment_sums(real, lo, hi)
        out = np.empty((len(texts), self.weights.shape[1]))
        for b in range(self.weights.shape[1]):
            w = self.weights[:, b].copy()
            w[blank] = 0
            out[:, b] = common.segment_sums(w[h], lo, hi)
        return out / np.maximum(n, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score and its distance from the runner-up, of each row."""
        z = margins / self.scale
        loss = np.stack([(np.logaddexp(0, -2 * z * row) * weight).sum(1) for row, weight in zip(self.code, self.trust, strict=True)], 1)
        best = loss.argmin(1)
        p = np.exp((loss.min(1, keepdims=True) - loss) * self.code.shape[1])
        p /= p.sum(1, keepdims=True)
        ranked = np.sort(p, 1)
        gap = ranked[:, -1] - ranked[:, -2] if p.shape[1] > 1 else ranked[:, -1]
        return best, p.max(1), gap


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: langs[i])
        texts, langs = [texts[i] for i in order], [langs[i] for i in order]
        for start, run in common.chunks(texts):
            buf, lo, hi = common.letters(run)
            h = ngrams(buf)
            for lang in dict.fromkeys(langs[start : start + len(run)]):
                own = [i for i in range(len(run)) if langs[start + i] == lang]
                part = h[max(0, lo[own[0]] - ORDER + 1) : hi[own[-1]]]
                seen = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                seen += np.bincount(part, minlength=1 << BITS)
    yield common.table_rows(counts)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", calibration_rows: int = 4000, smoothing: float = 0.5, max_langs: int = 100) -> LanguageModel:
    """Learn from the rows with a language; rows without letters add nothing."""
    learn = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    common_langs = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    learn = learn.where(F.col("lang").isin([r["lang"] for r in common_langs]))
    share = min(0.2, calibration_rows / max(1, sum(r["count"] for r in common_langs)))
    sampled = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))
    tables = common.summed_tables(learn.where(~sampled).mapInArrow(_count, common.TABLE_SCHEMA), 1 << BITS)
    blank = int(ngrams(np.full(4, 32, np.uint8))[0])
    for t in tables.values():
        t[blank] = 0
    langs = sorted(k for k, t in tables.items() if t.sum())
    code = codewords(len(langs))
    if not langs:
        return LanguageModel([], code, np.zeros((1 << BITS, 1), np.float32), np.ones(1), np.ones((0, 1)))
    p = np.stack([(tables[k] + smoothing) / (tables[k].sum() + smoothing * (1 << BITS)) for k in langs], 1)
    weights = np.empty((1 << BITS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        on, off = code[:, b] > 0, code[:, b] < 0
        weights[:, b] = np.log(p[:, on].mean(1)) - (np.log(p[:, off].mean(1)) if off.any() else 0)
    model = LanguageModel(langs, code, weights, np.ones(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    _calibrate(model, learn.where(sampled))
    return model


def _calibrate(model: LanguageModel, sample: DataFrame) -> None:
    """Margin scales and bit accuracies from rows that weren't counted."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(model)
    index = {k: i for i, k in enumerate(model.langs)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n, right, size = np.zeros(len(m.langs)), np.zeros(m.code.shape), np.zeros(m.code.shape[1])
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, run in common.chunks(texts):
                z = m.margins(run)
                for i in range(len(run)):
                    if (k := index.get(langs[start + i])) is not None:
                        n[k] += 1
                        right[k] += z[i] * m.code[k] > 0
                        size += np.abs(z[i])
        kinds = ["n"] * n.size + ["right"] * right.size + ["size"] * size.size
        places = [*range(n.size), *range(right.size), *range(size.size)]
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(places, pa.int32()), pa.array(np.concatenate([n, right.ravel(), size]))], names=["kind", "i", "v"])

    got = {(r["kind"], r["i"]): r["v"] for r in sample.mapInArrow(measure, "kind string, i int, v double").groupBy("kind", "i").agg(F.sum("v").alias("v")).collect()}
    n = np.array([got.get(("n", i), 0.0) for i in range(len(model.langs))])
    right = np.array([got.get(("right", i), 0.0) for i in range(model.code.size)]).reshape(model.code.shape)
    size = np.array([got.get(("size", i), 0.0) for i in range(model.code.shape[1])])
    model.scale = np.where(size > 0, size / max(n.sum(), 1), 1.0)
    accuracy = (right + 1) / (n[:, None] + 2)
    model.trust = accuracy / accuracy.sum(1, keepdims=True)


def judge(model: LanguageModel, texts: list[str | None], ambiguity: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, whether flagged as ambiguous, and margin of each text."""
    langs, scores, gaps = [], np.zeros(len(texts)), np.zeros(len(texts))
    for start, part in common.chunks(texts):
        best, score, gap = model.decode(model.margins(part)) if model.langs else (None, None, None)
        for i, t in enumerate(part):
            if t and model.langs and LETTER.search(t):
                langs.append(model.langs[best[i]])
                scores[start + i], gaps[start + i] = score[i], gap[i]
            else:
                langs.append(UND)
    return langs, scores, np.array([x != UND for x in langs], bool) & (gaps < ambiguity), gaps


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", ambiguity: float = 0.05) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, margin of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, flagged, gaps = judge(shared.value, batch.column(2).to_pylist(), ambiguity)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores), pa.array(flagged), pa.array(gaps)],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous", "margin"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (common.id_crc(id_col, 5) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(common.id_crc("doc_id", 5) != 0)))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, ambiguity: float = 0.05) -> DataFrame:
    """Pipeline stage: documents without a language, or between two, go; the rest stay as they are."""
    shared = spark.sparkContext.broadcast(fit(docs.where(common.id_crc("doc_id", 5) != 0)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, flagged, _ = judge(shared.value, batch.column(at).to_pylist(), ambiguity)
            yield batch.filter(pa.array([x != UND for x in langs], pa.bool_())).filter(pa.array([not f for x, f in zip(langs, flagged, strict=True) if x != UND], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
