import pickle
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import common, toxicity
from tests.llm.odd import docs, none


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(plain, 80).tolist()
        if i % 6 == 0:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), "vrax" + rng.choice(["um", "ol", "is", "ent", "ay"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(corpus):
    rows, labels = corpus
    return toxicity.fit(rows, labels.where(common.id_crc("doc_id", 4) != 2))


def test_held_out(corpus, model):
    rows, labels = corpus
    got = toxicity.score(rows, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_a_short_abuse_in_a_long_text_and_a_new_form(corpus, model):
    text = corpus[0].where("doc_id = 1").first()["text"]
    long = " ".join([text] * 40)
    assert model.score([long])[0][0] < 0.3 < model.score([long + " vraxum vraxol " + long])[0][0]
    assert model.score([text + " vraxorla vraxits"])[0][0] > model.score([text])[0][0]


def test_probabilities_equal_a_direct_recursion():
    classes = [toxicity.counts_by_order([b"abba", b"abc"], np.array([3.0, 1.0])), toxicity.counts_by_order([b"bab", b"cab"], np.array([2.0, 5.0]))]
    model, _ = toxicity.KneserNey.fit(classes)
    low = np.ones(256)
    for c in classes:
        for k in c[2][0]:
            low[int(k) & 255] += 1

    def p(c, key, n):
        if n == 1:
            return low[key & 255] / low.sum()
        keys, values = classes[c][n]
        ones, twos = (values == 1).sum(), (values == 2).sum()
        d = ones / (ones + 2 * twos) if ones else 0.5
        same = [(int(k), v) for k, v in zip(keys, values, strict=True) if int(k) >> 8 == key >> 8]
        base = p(c, key & ((1 << 8 * (n - 1)) - 1), n - 1)
        if not same:
            return base
        total = sum(v for _, v in same)
        return max(dict(same).get(key, 0) - d, 0) / total + d * len(same) / total * base

    for n in (2, 3, 4):
        hit, got = model.seen[n].get(np.union1d(classes[0][n][0], classes[1][n][0]))
        keys = np.union1d(classes[0][n][0], classes[1][n][0])
        assert hit.all() and np.allclose(got, [np.log(p(0, int(k), n) / p(1, int(k), n)) for k in keys], atol=1e-5)


def tokens(text):
    return (text or "").lower().encode().translate(common.LETTERS).split()


class Direct:
    """One class's probabilities by definition, over dictionaries."""

    def __init__(self, texts, low):
        self.low, self.words = low, Counter(w for t in texts for w in set(tokens(t)))
        self.counts = {toxicity.ORDER: Counter()}
        for n in range(toxicity.ORDER, 1, -1):
            c = self.counts[n] = Counter()
            for w, times in self.words.items():
                for seq in self.sequences(w):
                    if len(seq) == n:
                        c[seq] += times
            for seq in self.counts.get(n + 1, ()):
                c[seq[1:]] += 1
        self.pairs = Counter(p for t in texts for p in set(zip([None, *tokens(t)], tokens(t), strict=False)))
        self.first = Counter()
        for (a, _), n in self.pairs.items():
            self.first[a] += n
        self.discount = {n: self._discount(c) for n, c in self.counts.items()}
        self.pair_discount = self._discount(self.pairs)
        self.known = {}

    @staticmethod
    def _discount(counts):
        ones, twos = (sum(v == k for v in counts.values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones else 0.5

    @staticmethod
    def sequences(word):
        whole = b" " + word + b" "
        return [whole[max(0, i - toxicity.ORDER + 1) : i + 1] for i in range(1, len(whole))]

    def byte(self, seq):
        if len(seq) == 1:
            return self.low[seq[0]] / sum(self.low)
        if seq not in self.known:
            counts, d = self.counts[len(seq)], self.discount[len(seq)]
            same = {k: v for k, v in counts.items() if k[:-1] == seq[:-1]}
            base = self.byte(seq[1:])
            self.known[seq] = max(same.get(seq, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * base if same else base
        return self.known[seq]

    def word(self, w):
        return np.prod([self.byte(seq) for seq in self.sequences(w)])

    def after(self, a, w, kept):
        total = self.first[a]
        left = 1 - sum(max(self.pairs[p] - self.pair_discount, 0) for p in kept.get(a, ())) / total if total else 1.0
        own = max(self.pairs[a, w] - self.pair_discount, 0) / total if total and (a, w) in kept.get(a, ()) else 0.0
        return own + left * self.word(w)


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(11)
    plain, rude = ["la", "mira", "sol", "tena", "or", "marisol"], ["vrax", "vraxen"]
    rows = []
    for i in range(120):
        words = rng.choice(plain, int(rng.integers(1, 12))).tolist()
        if i % 4 == 0:
            words[int(rng.integers(len(words))):0] = ["you", str(rng.choice(rude))]
        rows.append((i, " ".join(words).capitalize() + "."))
    rows += [(500, None), (501, "12 !"), (502, "You vraxor, marisol tenaor"), (503, "mira")]
    labels = [(i, int(i % 4 == 0)) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, str(tmp_path)).collect()}
    sample = {}
    for i, t in rows[:120]:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            sample[t] = max(sample.get(t, 0), labels[i][1])
    part = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in sample], "t string").withColumn("x", F.pmod(F.xxhash64(F.sha2("t", 256)), F.lit(4))).collect()}
    learnt = [[t for t, y in sample.items() if part[t] and y == c] for c in (1, 0)]
    low = np.ones(256)
    for _ in range(2):  # the lowest order counts the two-byte sequences of both classes
        low = np.ones(256)
        classes = [Direct(texts, low) for texts in learnt]
        for c in classes:
            for seq in c.counts[2]:
                low[seq[-1]] += 1
    both = classes[0].pairs + classes[1].pairs
    kept = {}
    for pair, n in both.items():
        if n >= toxicity.PAIR_TEXTS:
            kept.setdefault(pair[0], []).append(pair)
    for a in {p[0] for p in both}:
        assert all(sum(c.after(a, w, kept) for w in {p[1] for p in kept.get(a, ())}) <= 1 + 1e-9 for c in classes)

    def measure(text):
        words = tokens(text)
        ratios = [np.log(classes[0].after(a, w, kept) / classes[1].after(a, w, kept)) for a, w in zip([None, *words], words, strict=False)]
        size = [len(w) + 1 for w in words]
        passages = [sum(ratios[max(0, k - toxicity.PASSAGE + 1) : k + 1]) / sum(size[max(0, k - toxicity.PASSAGE + 1) : k + 1]) for k in range(len(words))]
        return len(words), sum(ratios) / max(sum(size), 1), max(passages, default=0.0), sum(max(x - toxicity.SUPPORT, 0) for x in passages), max((r / b for r, b in zip(ratios, size, strict=True)), default=0.0)

    def design(texts):
        return toxicity._design(*(np.array(x, float) for x in zip(*map(measure, texts), strict=True)))

    tests = [t for t in sample if not part[t]]
    weights = toxicity._logistic(design(tests), np.array([sample[t] for t in tests], float))
    for i, t in rows:
        n, mean, peak, *_ = measure(t)
        want = 1 / (1 + np.exp(-(design([t]) @ weights)[0])) if n else 0.0
        assert got[i]["score"] == pytest.approx(want, abs=2e-3), (t, n)
        assert got[i]["mean"] == pytest.approx(mean, abs=1e-4) and got[i]["peak"] == pytest.approx(peak, abs=1e-4)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_sequences_after_one_byte_are_kept():
    classes = [toxicity.counts_by_order([b"moron"], np.array([50.0])), toxicity.counts_by_order([b"table"], np.array([50.0]))]
    model = pickle.loads(pickle.dumps(toxicity.KneserNey.fit(classes)[0]))
    for n in range(2, toxicity.ORDER + 1):
        keys = np.union1d(classes[0][n][0], classes[1][n][0])
        assert model.seen[n].get(keys)[0].all() and model.backoff[n].get(np.unique(keys >> toxicity.EIGHT))[0].all()
    assert model.seen[5].get(np.array([int.from_bytes(b"moron", "big")], np.uint64))[0].all()


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    table = toxicity.Lookup(keys, np.arange(len(keys)))
    hit, value = table.get(np.concatenate([keys, keys + np.uint64(1)]))
    assert hit[: len(keys)].all() and (value[: len(keys)] == np.arange(len(keys))).all() and not hit[len(keys) :].any()


def test_odd_rows(spark, model):
    got = toxicity.score(docs(spark), model).collect()
    assert len(got) == docs(spark).count() and all(r["score"] == 0 for r in got if r["doc_id"] in (0, 1, 2, 10))
    assert toxicity.score(none(spark), model).count() == 0
    nothing = toxicity.fit(docs(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing is None and {r["score"] for r in toxicity.score(docs(spark), nothing).collect()} == {0.0}
