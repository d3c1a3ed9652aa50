import random
import re

import pytest
from pyspark.sql import functions as F

from lexweave.llm import packing
from tests.llm.odd import docs, none, rows


def brute(sizes, lengths, preferred, overhead, quadratic):
    """Best fit by looking at every open bin."""
    bins = []
    left = sum(sizes)
    for n in sizes:
        fitting = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n]
        if fitting:
            k = min(fitting)[1]
        else:
            fits = [c for c in lengths if c >= n]
            room = min(fits, key=lambda c: (packing.cost(c, overhead, quadratic) / min(c, left), c)) if preferred is None else max(preferred, fits[0])
            bins.append({"room": room, "used": 0})
            k = len(bins) - 1
        bins[k]["room"] -= n
        bins[k]["used"] += n
        left -= n
    return sum(packing.cost(next(c for c in lengths if c >= b["used"]), overhead, quadratic) for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_block_equals_brute_force(seed):
    rng = random.Random(seed)
    sizes = [min(4096, int(rng.expovariate(1 / 500)) + 1) for _ in range(200)]
    places, final = packing.pack_block(sizes)
    down = sorted(sizes, reverse=True)
    assert sum(packing.cost(c, 64, 32768) for c in final) == pytest.approx(min(brute(down, packing.LENGTHS, p, 64, 32768) for p in (None, *packing.LENGTHS)))
    used = [[] for _ in final]
    for n, (b, o) in zip(sizes, places, strict=True):
        used[b].append((o, n))
    for b, c in zip(used, final, strict=True):
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b))
        total = sum(n for _, n in b)
        assert total <= c and not any(total <= d < c for d in packing.LENGTHS)


@pytest.mark.parametrize("block_rows", [7, 1 << 14])
def test_every_token_is_packed_once(spark, block_rows):
    got = packing.pack(docs(spark), packing.words(), block_rows=block_rows).collect()
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows()]
    chunks = {}
    for r in got:
        chunks.setdefault(r["doc_id"], []).append(r)
    assert sum(r["n_tokens"] for r in got) == sum(want)
    assert all((r["bin_id"] is None) == (r["n_tokens"] == 0) for r in got)
    long = sorted(chunks[13], key=lambda r: r["chunk"])
    assert [r["first_token"] for r in long] == [k * 4096 for k in range(len(long))] and sum(r["n_tokens"] for r in long) == 20000
    bins = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault((r["bin_id"], r["bin_capacity"]), []).append((r["bin_offset"], r["n_tokens"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, c), held in bins.items():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= c


def test_fill_and_empty(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("n"))
    got = packing.pack(df, F.col("n")).groupBy("bin_id").agg(F.sum("n_tokens").alias("used"), F.first("bin_capacity").alias("c")).agg(F.sum("used") / F.sum("c")).first()[0]
    assert got > 0.97
    assert packing.pack(none(spark), packing.words()).count() == 0
