import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lexweave.llm import quality
from tests.llm.odd import docs, none


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    good, bad = [f"good{i}" for i in range(50)], [f"bad{i}%%" for i in range(50)]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good, 60))) for i in range(400)]
    labels = [(i, int(i % 5 != 0)) for i in range(0, 400, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_draw(spark, corpus):
    rows, labels = corpus
    share = quality.target_share(labels)
    got = quality.resample(rows, quality.fit(rows, labels), share).collect()
    chosen = {r["doc_id"] for r in got if r["selected"]}
    assert len(got) == 400 and len(chosen) == math.ceil(share * 400)
    assert sum(i % 5 == 0 for i in chosen) <= 3
    top = sorted((r["key"] for r in got), reverse=True)[len(chosen) - 1]
    assert all(r["selected"] == (r["key"] >= top) for r in got)


def test_weight_equals_brute_force(spark):
    ratio = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32)
    buckets, doc = quality.hashed_ngrams(["a b", "", None, "c a b c", "a"])
    assert np.bincount(doc, minlength=5).tolist() == [3, 0, 0, 7, 1]
    one = {w: quality.hashed_ngrams([w])[0][0] for w in "abc"}
    pair = {p: quality.hashed_ngrams([p])[0][2] for p in ("a b", "c a", "b c")}
    want = sum(ratio[one[w]] for w in "cabc") + sum(ratio[p] for p in pair.values())
    assert np.bincount(doc, ratio[buckets])[3] == pytest.approx(want, rel=1e-5)


def brute(rows, labels, keep):
    """Kept ids and log weights: n-gram models, importance weights and the Gumbel draw by definition."""
    known = {}

    def grams(text):
        words = (text or "").split()
        for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            if g not in known:
                known[g] = int(quality.hashed_ngrams([g])[0][-1])
        return [known[g] for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]

    good = {i for i, y in labels if y == 1}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    size, n_raw, n_target = 1 << quality.BITS, sum(raw.values()), sum(target.values())

    def ratio(g):
        q = (raw[g] + 1) / (n_raw + size)
        return math.log((target[g] + 1000 * q) / (n_target + 1000) / q)

    weight = {i: sum(map(ratio, grams(t))) if n_target else 0.0 for i, t in rows}
    noise = dict(zip([i for i, _ in rows], quality.gumbel(np.array([i for i, _ in rows]), 1), strict=True))
    key = {i: weight[i] / (len(grams(t)) + quality.SHORT) * quality.NOMINAL + noise[i] for i, t in rows}
    return set(sorted(key, key=key.get, reverse=True)[: math.ceil(keep * len(rows))]), weight


def test_query_equals_brute_force(spark, corpus, tmp_path):
    rows = [(r[0], r[1]) for r in corpus[0].collect()] + [(900, None), (901, ""), (902, "good1")]
    labels = [(r[0], r[1]) for r in corpus[1].collect()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    learn = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    kept, weight = brute(rows, learn, sum(y for _, y in learn) / len(learn))
    got = quality.op10_quality(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got if r["selected"]} == kept and len(got) == len(rows)
    assert all(r["log_weight"] == pytest.approx(weight[r["doc_id"]], rel=1e-4, abs=1e-3) for r in got)


def test_word_hashes_split_like_python():
    texts = ["", None, " x ", "a\n\nb\tc", "long-word-over-eight-bytes long-word-over-eight-bytes!", "é é"]
    w, at = quality.word_hashes(texts)
    assert np.diff(at).tolist() == [len((t or "").split()) for t in texts]
    assert w[at[5]] == w[at[5] + 1] and w[at[4]] != w[at[4] + 1]


def test_kth_largest(spark):
    values = [5, -3, 2**62, -(2**62), 5, 0, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, 9):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    x = np.array([1.5, -2.0, 0.0, -0.0, 1e300, -1e-300])
    assert (np.argsort(quality.ordered(x), kind="stable") == np.argsort(x, kind="stable")).all()


def test_gumbel_moments():
    g = quality.gumbel(np.arange(200_000), 1)
    assert g.mean() == pytest.approx(0.5772, abs=0.01) and g.std() == pytest.approx(math.pi / math.sqrt(6), abs=0.01)


def test_odd_rows(spark, corpus):
    rows, labels = corpus
    ratio = quality.fit(rows, labels)
    got = quality.resample(docs(spark), ratio, 0.5).collect()
    assert len(got) == docs(spark).count() and sum(r["selected"] for r in got) >= len(got) / 2
    assert all(r["log_weight"] == 0 for r in got if not r["n_ngrams"])
    assert quality.resample(none(spark), ratio, 0.5).count() == 0
    empty_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert not quality.fit(docs(spark), empty_labels).any() and quality.target_share(empty_labels) == 1.0
