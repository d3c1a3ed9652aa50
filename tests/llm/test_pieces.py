from collections import Counter

import numpy as np
import pytest

from lexweave.llm import pieces
from tests.llm.odd import TEXTS, docs, none


@pytest.fixture(scope="module")
def voc():
    return pieces.Vocabulary.load(pieces.default_model())


def test_lossless_and_reproducible(voc):
    texts = [*TEXTS, " lead", "trail ", "a  b   c", "▁", "▁▁ ▁", "tab\tnew\nline\r", "ñandú Straße naïve œuvre", "\x00\x01", "👩‍👩‍👧", "​"]
    ids = pieces.sample(texts, np.arange(len(texts)), voc)
    for t, x in zip(texts, ids, strict=True):
        assert (x is None) if t is None else pieces.decode_ids(x, voc) == t
    for k in range(len(texts)):
        (alone,) = pieces.sample([texts[k]], np.array([k]), voc)
        assert (alone is None) == (ids[k] is None) and (alone is None or (alone == ids[k]).all())
    other = pieces.sample(texts, np.arange(len(texts)), voc, seed=2)
    assert any(len(a) != len(b) for a, b in zip(ids, other, strict=True) if a is not None)


def brute(text, voc):
    """Probability of every segmentation of a text into pieces of the vocabulary."""
    weight = {voc.pieces[i]: voc.weights[i] for i in voc.piece_of.tolist() if i >= 0}
    out = {}

    def go(rest, so_far, total):
        if not rest:
            out[so_far] = np.exp(total)
        for n in range(1, len(rest) + 1):
            if (p := rest[:n].encode()) in weight:
                go(rest[n:], (*so_far, p), total + weight[p])

    go(" " + text, (), 0.0)
    norm = sum(out.values())
    return {k: v / norm for k, v in out.items()}


def test_full_tables_change_no_draw(voc, monkeypatch):
    texts = [f"{t} {i}" for i in range(40) for t in TEXTS if t and len(t) < 200] + [TEXTS[-1]]
    keys = np.arange(len(texts))
    want = pieces.sample(texts, keys, voc)
    monkeypatch.setattr(pieces, "PLACES", 50)
    monkeypatch.setattr(pieces, "EDGES", 60)
    small = pieces.Vocabulary.load(pieces.default_model())
    for part in (slice(0, 3), slice(3, 200), slice(200, None)):
        for a, b in zip(pieces.sample(texts[part], keys[part], small), want[part], strict=True):
            assert (a == b).all()


@pytest.mark.parametrize("text", ["then", "in a", "  x", "the end, so", "2024 x", "Größe", "a--b", "日本", "isis isis"])
def test_draws_follow_the_lattice(voc, text):
    n = 6000
    drawn = Counter(tuple(voc.pieces[i] for i in x) for x in pieces.sample([text] * n, np.arange(n), voc))
    want = brute(text, voc)
    assert set(drawn) <= set(want)
    for k, p in want.items():
        assert drawn[k] / n == pytest.approx(p, abs=4 * (p * (1 - p) / n) ** 0.5 + 1e-3)


def test_frames(spark, voc):
    got = pieces.encode(docs(spark))
    again = {r["doc_id"]: r["text"] for r in pieces.decode(got).collect()}
    assert all(again[i] == t for i, t in enumerate(TEXTS))
    rows = pieces.segment_digests(docs(spark)).collect()
    assert len(rows) == docs(spark).count() and all(r["lossless"] is not False for r in rows)
    assert {r["n_ids"] for r in rows if r["doc_id"] == 0} == {None} and {r["n_ids"] for r in rows if r["doc_id"] == 1} == {0}
    assert len({r["ids_sha256"] for r in rows if r["doc_id"] == 3}) == 1
    assert pieces.segment_digests(none(spark)).count() == 0
