import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import chroma, common
from tests.llm.odd import docs, none


def song(seed, n):
    return " ".join(f"note{x}" for x in np.random.default_rng(seed).integers(0, 500, n))


def test_pitch_classes_of_a_tone():
    t = np.arange(4000) / chroma.RATE
    (frames,) = chroma.pitch_classes([np.sin(2 * np.pi * 440 * t).astype(np.float32)])
    assert (frames.argmax(1)[:-1] == 0).all() and np.allclose(frames.sum(1), 1, atol=1e-4)
    silent, empty = chroma.pitch_classes([np.zeros(2000, np.float32), np.zeros(0)])
    assert len(silent) and not silent.any() and len(empty) == 0 and chroma.pitch_classes([]) == chroma.packed([]) == []


def integers(*recordings):
    return chroma.packed(chroma.pitch_classes(list(recordings)))


def test_recordings_beside_it_change_nothing():
    heard = [chroma.sonify(song(i, n)) for i, n in enumerate((40, 0, 1, 3, 300, 9, 8, 7))]
    for one, among in zip(heard, integers(*heard), strict=True):
        assert (integers(one)[0] == among).all() and len(integers(one)[0]) == len(among)


def test_integral_image_equals_direct_sums():
    classes = np.random.default_rng(1).random((20, 12)).astype(np.float32)
    _, got = chroma.packed([classes[:3], classes])
    assert len(got) == 13
    for t in (0, 5, 12):
        value = 0
        for boxes in chroma.FILTERS:
            area = [0.0, 0.0]
            for sign, f, w, y, h in boxes:
                area[sign < 0] += classes[t + f : t + f + w, y : y + h].sum(dtype=float)
            r = np.log((area[0] + 0.05) / (area[1] + 0.05))
            value = value << 2 | int(chroma.GRAY[np.searchsorted([-0.6, 0.0, 0.6], r)])
        assert got[t] == value


def test_pcm16_and_noise():
    rng = np.random.default_rng(2)
    clean = chroma.sonify(song(1, 60))
    noisy = clean + 0.05 * rng.normal(size=len(clean))
    raw = (noisy / np.abs(noisy).max() * 32000).astype("<i2").tobytes()
    a, b = integers(clean, chroma.pcm16(raw))
    overlap, errors = chroma.align(a, b, 0)
    assert overlap == len(a) and errors < 0.1
    assert chroma.align(a, integers(chroma.sonify(song(9, 60)))[0], 0)[1] > 0.3


@pytest.fixture(scope="module")
def songs(spark):
    rows = [(k, song(k, 40)) for k in range(40)]
    rows += [(100, rows[0][1]), (101, song(77, 13) + " " + rows[0][1]), (102, rows[20][1]), (103, rows[20][1]), (50, song(50, 50)), (150, "")]
    return spark.createDataFrame(rows, "id long, text string")


def brute(prints, k):
    out = {}
    for q, a in prints.items():
        if q % 50:
            continue
        hits = []
        for r, b in prints.items():
            if r == q or not len(a) or not len(b):
                continue
            offsets = {}
            for i, x in enumerate(a):
                for j in np.flatnonzero(b == x):
                    offsets[int(j) - i] = offsets.get(int(j) - i, 0) + 1
            if not offsets:
                continue
            off = max(offsets, key=lambda o: (offsets[o], -o))
            overlap, errors = chroma.align(a, b, off)
            if offsets[off] >= min(3, len(a), len(b)) and errors <= 0.25 and 2 * overlap >= min(len(a), len(b)):
                hits.append((errors, (r,), off))
        out[q] = (len(hits), sorted(hits)[:k])
    return out


@pytest.mark.parametrize("block", [40, 1 << 18])
def test_search_equals_brute_force(spark, songs, block):
    prints = chroma.fingerprints(songs, ["id"], "text", chroma.sonify)
    got = chroma.search(prints, F.col("key.id") % 50 == 0, block_frames=block).collect()
    want = brute({r["id"]: integers(chroma.sonify(r["text"]))[0] for r in songs.collect()}, 3)
    assert {r["key"]["id"]: (r["n_matches"], [(m["errors"], tuple(m["key"]), m["offset"]) for m in r["best"] or []]) for r in got} == want
    assert want[0][0] == 2 and want[0][1][1][2] == 13 and want[100][0] == 2


@pytest.mark.parametrize("block", [40, 1 << 18])
def test_matches_and_members_give_every_pair(spark, block):
    rows = [(k, song(k, 40)) for k in range(10)] + [(20 + k, song(0, 40)) for k in range(5)] + [(30 + k, song(60 + k, 9 + k) + " " + song(0, 40)) for k in range(5)]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, text string"), ["id"], "text", chroma.sonify).cache()
    placed = chroma.members(prints, F.col("key.id") % 50 == 0).cache()
    of = {}
    for r in placed.collect():
        of.setdefault(r["class"], []).append(r["key"]["id"])
    found = chroma.matches(placed, block_frames=block).collect()
    got = sorted((r["errors"], (k,), r["offset"]) for r in found if 0 in of[r["query_class"]] for k in of[r["class"]] if k)
    want = brute({r["key"]["id"]: np.frombuffer(r["fp"], "<u4") for r in prints.collect()}, None)[0]
    assert got == want[1] and len(got) == want[0] >= 10
    assert len(found) == len({(r["query_class"], r["class"]) for r in found}) < want[0]


def test_blocks_are_read_again_for_every_held_part(spark, tmp_path):
    """With little room, recordings meet the same blocks part by part; blocks beyond the kept ones are read anew."""
    rows = [(k, chroma.packed(chroma.pitch_classes([chroma.sonify(song(k % 7, 30 + k % 3))]))[0].astype("<u4").tobytes()) for k in range(24)]
    spark.createDataFrame(rows, "class long, fp binary").coalesce(2).write.parquet(str(tmp_path / "q"))
    assert [len(b.names) for b in chroma._blocks(str(tmp_path / "q"), 40)] == [2] * 12

    class Wanted:
        value = common.bitmap(spark.createDataFrame(rows, "class long, fp binary").mapInArrow(chroma._values, "value long"))

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["class", "fp"])
    want = None
    for held, kept, size in ((1 << 24, 4, 1 << 18), (150, 4, 40), (150, 100, 40), (1, 1, 1 << 18)):
        old = chroma.HELD, chroma.KEPT_BLOCKS, chroma.RECORDINGS
        chroma.HELD, chroma.KEPT_BLOCKS, chroma.RECORDINGS = held, kept, 5
        try:
            got = sorted(tuple(r.values()) for b in chroma._meet(str(tmp_path / "q"), Wanted, 3, 0.25, size)(iter([batch])) for r in b.to_pylist())
        finally:
            chroma.HELD, chroma.KEPT_BLOCKS, chroma.RECORDINGS = old
        want = want or got
        assert got == want and len(got) >= 24


def test_odd_rows(spark):
    odd = chroma.fingerprints(docs(spark), ["doc_id", "n_chars"], "text", chroma.sonify)
    got = chroma.search(odd, F.lit(True)).collect()
    assert len(got) == docs(spark).count()
    twins = [r for r in got if r["key"]["doc_id"] == 3]
    assert all(r["n_matches"] >= 1 for r in twins)
    assert chroma.search(chroma.fingerprints(none(spark), ["doc_id"], "text", chroma.sonify), F.lit(True)).count() == 0
