import hashlib
from collections import Counter

import numpy as np
import pytest

from lexweave.llm import common
from lexweave.llm import fingerprints as fp
from lexweave.llm.quality import word_hashes
from tests.llm.odd import docs, none, rows


def bag(text):
    doc, term, n = fp.weighted_terms([text])
    return dict(zip(term.tolist(), n.tolist(), strict=True))


def test_collisions_follow_generalised_jaccard():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    signed = exact = 0.0
    for _ in range(60):
        base = rng.choice(words, 80).tolist()
        other = base[:50] + rng.choice(words, 30).tolist()
        a, b = bag(" ".join(base)), bag(" ".join(other))
        exact += sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        x, y = fp.signatures([" ".join(base), " ".join(other)])
        signed += fp.likeness(x, y)
    assert signed / 60 == pytest.approx(exact / 60, abs=0.025)


@pytest.mark.parametrize("n", [5_000, 100_000])
def test_long_unrelated_texts_are_unlike(n):
    x, y = fp.signatures([" ".join(f"{side}{i}" for i in range(n)) for side in "ab"])
    assert fp.likeness(x, y) < 0.05


def test_terms_of_one_place_and_slices(monkeypatch):
    terms = np.arange(50, dtype=np.uint64) + np.uint64(5 << 60)
    for _ in range(2):
        r, c, b = fp.variates(terms)
        assert np.array_equal(fp._weight_one(terms), c - r * (1 - b))
    texts = ["a b a b c", None, " ".join(f"w{i % 300} v" for i in range(500)), "", "a b a b d"]
    whole = fp.signatures(texts)
    monkeypatch.setattr(fp, "SLICE", 7)
    assert all(np.array_equal(x, y) for x, y in zip(whole, fp.signatures(texts), strict=True))


def brute_signature(text):
    """Every term by definition, from a dictionary of word pairs."""
    words, at = word_hashes([text.lower()])
    spelt = text.lower().split()
    assert len(spelt) == len(words)
    named = dict(zip(spelt, words, strict=True))
    pairs = Counter(zip([None, *spelt], spelt, strict=False))
    if not pairs:
        return None
    weights = Counter()
    for (a, b), n in pairs.items():
        first = np.array([0 if a is None else named[a]], np.uint64)
        weights[int(common.mix(first * np.uint64(3) ^ np.array([named[b]], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])] += n
    assert len(weights) == len(pairs), "different pairs are different terms"
    least, best = np.full(fp.SAMPLES, np.inf), np.zeros(fp.SAMPLES, np.uint16)
    for term, n in weights.items():
        one = np.array([term], np.uint64)
        r, c, b = (x[0] for x in fp.variates(one))
        t = np.floor(np.log(np.float32(n)) / r + b)
        value = c - r * (t - b + 1) if n > 1 else c - r * (1 - b)
        code = fp._codes(one, t.astype(np.int64))
        best = np.where((value < least) | (value == least) & (code > best), code, best)
        least = np.minimum(value, least)
    return best


def test_query_equals_brute_force_on_long_texts(spark, tmp_path):
    rng = np.random.default_rng(2)
    long = [" ".join(f"{side}{x}" for x in rng.integers(0, size, 20_000)) for side, size in (("a", 10**9), ("b", 10**9), ("a", 300))]
    texts = [long[0], long[1], long[2], long[0][: len(long[0]) // 2] + " " + long[1], "short one", "", None, "a a a a b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fp.op8_fingerprint(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    own = [brute_signature(t or "") for t in texts]
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""
        edited = brute_signature(fp.edit(t, following))
        assert got[i]["fingerprint"] == fp._text_of(own[i]) and got[i]["edited_fingerprint"] == fp._text_of(edited)
        assert got[i]["near_next"] == fp.likeness(own[i], own[i - 1]) and got[i]["near_edited"] == fp.likeness(own[i], edited)
    assert got[1]["near_next"] == 0 and 0.5 < got[0]["near_edited"] < 1


def brute(rows_):
    order = sorted(rows_, key=lambda r: (r[0] is not None, r[0] or 0, ), reverse=True)
    order = sorted(order, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for k, r in enumerate(order):
        text, following = r[1] or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        out.append((r[0], len(text), hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_order_and_edits_equal_brute_force(spark):
    for width in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        got = fp.fingerprint(docs(spark)).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == brute(rows())
    many = [(i * 7, f"text number {i} " + "w " * (i % 13)) for i in range(500)]
    got = fp.fingerprint(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == brute(many)


def test_equal_texts_and_likeness(spark):
    got = {}
    for r in fp.fingerprint(docs(spark)).collect():
        got.setdefault(r["doc_id"], r)
    assert got[8]["fingerprint"] == got[9]["fingerprint"] and got[9]["near_next"] == 1.0
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == ""
    assert got[2]["near_next"] == 1.0 and got[14]["near_next"] > 0.9 and got[14]["near_edited"] < 1


def test_empty_and_single(spark):
    assert fp.fingerprint(none(spark)).count() == 0
    (r,) = fp.fingerprint(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0
