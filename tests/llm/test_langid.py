import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import common, langid
from tests.llm.odd import docs, none

WORDS = {"en": "the and of that with this for are was not".split(), "de": "der und die nicht mit das für ist war ein".split(), "fr": "le les des une dans pour avec que qui est".split()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, " ".join(rng.choice(WORDS[k], 40)), k) for i, k in enumerate(rng.choice(list(WORDS), 300).tolist())], "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, corpus):
    model = langid.fit(corpus.where(common.id_crc("doc_id", 5) != 0))
    got = langid.predict(corpus, model).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 30 and got.where("lang <> lang_pred").count() == 0
    assert got.where("score < 0 OR score > 1").count() == 0
    mixed = langid.judge(model, [" ".join(WORDS["en"] + WORDS["de"]), "nothing 12"], 1.1)
    assert mixed[2].all()


def test_codewords_differ():
    for n in (2, 3, 5, 7, 12, 30):
        code = langid.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert apart[np.triu_indices(n, 1)].min() >= (1 if n < 4 else 4)
        assert (np.abs(code.sum(0)) < n).all()


def test_margin_equals_brute_force():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(1 << langid.BITS, 2)).astype(np.float32)
    model = langid.LanguageModel(["a", "b"], np.ones((2, 2)), weights, np.ones(2), np.ones((2, 2)))
    text = "Größe ist 12 nicht alles"
    raw = (" " * 8 + text.lower().encode().translate(common.LETTERS).decode("utf-8") + " " * 8).encode()
    grams = [raw[i : i + 4] for i in range(5, len(raw) - 8) if raw[i : i + 4] != b"    "]
    want = np.mean([weights[langid.ngrams(np.frombuffer(g, np.uint8))[0]] for g in grams], axis=0)
    assert np.allclose(model.margins(["other", text, None])[1], want, atol=1e-5)


def test_odd_rows(spark, corpus):
    model = langid.fit(corpus)
    got = langid.predict(docs(spark), model).collect()
    assert len(got) == docs(spark).count()
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 10)} == {"und"}
    assert langid.predict(none(spark), model).count() == 0
    unlearnt = langid.fit(none(spark))
    assert {r["lang_pred"] for r in langid.predict(docs(spark), unlearnt).collect()} == {"und"}
    kept = langid.keep_identified(spark, docs(spark), "")
    assert kept.columns == docs(spark).columns and kept.where(F.col("text").isNull()).count() == 0
    assert langid.keep_identified(spark, none(spark), "").count() == 0


def test_query_equals_brute_force(spark, corpus, tmp_path):
    """Counts, codewords, margins, bit trust and decoding, each by definition on byte strings."""
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in langid.op4_language_id(spark, str(tmp_path)).collect()}
    rows = [(r["doc_id"], r["text"], r["lang"], r["x"] % (1 << 20)) for r in corpus.withColumn("x", F.xxhash64("text")).collect()]
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    share = int(0.2 * (1 << 20))
    counted, sample = [r for r in learn if r[3] >= share], [r for r in learn if r[3] < share]
    assert len(sample) > 20

    def grams(text):
        raw = b" " * 3 + text.lower().encode().translate(common.LETTERS) + b" " * 3
        return [int(langid.ngrams(np.frombuffer(raw[i : i + 4], np.uint8))[0]) for i in range(len(raw) - 3) if raw[i : i + 4] != b"    "]

    langs, size = sorted(WORDS), 1 << langid.BITS
    counts = {k: Counter(g for r in counted if r[2] == k for g in grams(r[1])) for k in langs}
    p = {k: lambda g, c=counts[k], n=sum(counts[k].values()): (c[g] + 0.5) / (n + 0.5 * size) for k in langs}
    code = dict(zip(langs, langid.codewords(3).tolist(), strict=True))
    assert sorted(len(set(c)) for c in zip(*code.values(), strict=True)) == [2, 2, 2], "every bit parts the languages"

    def margin(text):
        out = []
        for b in range(3):
            on, off = ([k for k in langs if code[k][b] == x] for x in (1, -1))
            out.append(np.mean([np.log(np.mean([p[k](g) for k in on])) - np.log(np.mean([p[k](g) for k in off])) for g in grams(text)]))
        return np.array(out)

    z = {r[0]: margin(r[1]) for r in rows}
    scale = np.mean([np.abs(z[r[0]]) for r in sample], axis=0)
    trust = {k: np.array([(sum(z[r[0]][b] * code[k][b] > 0 for r in sample if r[2] == k) + 1) / (sum(r[2] == k for r in sample) + 2) for b in range(3)]) for k in langs}
    for i, _, _, _ in rows:
        loss = {k: (np.log(1 + np.exp(-2 * z[i] / scale * code[k])) * trust[k] / trust[k].sum()).sum() for k in langs}
        best = min(loss, key=loss.get)
        odds = {k: np.exp(3 * (loss[best] - loss[k])) for k in langs}
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 / sum(odds.values()), abs=2e-4)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_rare_languages_beyond_the_bound_are_not_learnt(spark, corpus):
    odd = spark.createDataFrame([(9000 + i, "zz yy xx", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.fit(corpus.unionByName(odd), max_langs=3).langs == sorted(WORDS)
