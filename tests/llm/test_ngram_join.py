import re

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import common, graph
from lexweave.llm import ngram_join as nj
from tests.llm.odd import docs, none, rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(data):
    """(doc_id, n_shingles, component_id, n_links) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in data]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(sets)
    for k, (i, a) in enumerate(sets):
        for m, (j, b) in enumerate(sets[:k]):
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
                links[k] += 1
                links[m] += 1
    return sorted(((i, len(s), None if i is None else root(i), n) for (i, s), n in zip(sets, links, strict=True)), key=str)


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(200)]
    base = [rng.choice(words, rng.integers(5, 120)).tolist() for _ in range(n // 5)]
    passage = rng.choice(words, 60).tolist()
    out = []
    for i in range(n):
        t = list(base[int(rng.integers(len(base)))])
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(len(t)))] = str(rng.choice(words))
        if rng.random() < 0.3:
            t += passage
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize(("seed", "block", "salt"), [(1, 2048, 1 << 16), (2, 7, 1 << 16), (3, 2048, 2), (4, 5, 3)])
def test_equals_all_pairs(spark, seed, block, salt):
    data = corpus(seed)
    got = nj.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), block=block, salt_rows=salt).collect()
    assert sorted(map(tuple, got), key=str) == brute(data)


@pytest.mark.parametrize("window", [0, 2, 9])
def test_equals_all_pairs_at_any_window(spark, window):
    data = corpus(9)
    got = nj.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), block=11, window=window).collect()
    assert sorted(map(tuple, got), key=str) == brute(data)


def test_shared_passages_gather_no_cluster(spark, monkeypatch):
    """Each text shares a third with the next, too little to link: only the few near copies are loaded, however long the chain is."""
    rng = np.random.default_rng(13)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(151)]
    data = [(i, f"{passages[i]} {passages[i + 1]}") for i in range(150)]
    data += [(200 + i, data[i][1] + " more") for i in range(0, 150, 15)]
    loaded, verified_links = [], nj.verified_links
    monkeypatch.setattr(nj, "verified_links", lambda docs, tasks, level: loaded.append(tasks.count()) or verified_links(docs, tasks, level))
    got = nj.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), block=7).collect()
    assert sorted(map(tuple, got), key=str) == brute(data)
    assert loaded == [20]


def test_parity_tables_never_tell_apart_more_than_differs():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, int(rng.integers(1, 700)), dtype=np.uint64)
        sets += [set(base.tolist()), set(base[: int(rng.integers(1, len(base) + 1))].tolist()) | set(rng.integers(0, 2**63, int(rng.integers(0, 90)), dtype=np.uint64).tolist())]
    n = np.array([len(x) for x in sets])
    tables = nj.parity_tables(np.concatenate([np.array(sorted(x), np.uint64) for x in sets]), np.repeat(np.arange(len(sets)), n), n)
    assert all(8 * len(t) >= k for t, k in zip(tables, n, strict=True))
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    found = nj.differing([tables[i] for i, _ in pairs], [tables[j] for _, j in pairs])
    assert all(d <= len(sets[i] ^ sets[j]) for d, (i, j) in zip(found.tolist(), pairs, strict=True))
    assert all(d > (n[i] + n[j]) // 7 for d, (i, j) in zip(found.tolist(), pairs, strict=True) if not sets[i] & sets[j] and min(n[i], n[j]) > 100 and 3 * n[i] <= 4 * n[j] <= 4 * n[i])
    assert nj.differing([None, tables[0]], [tables[0], None]).tolist() == [0, 0]


def test_odd_rows(spark):
    got = nj.near_duplicates(docs(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r[0], r[1]) for r in rows()])
    assert nj.near_duplicates(none(spark)).count() == 0


def test_pipeline_stage_keeps_one_of_each_group(spark):
    data = corpus(6, 60)
    kept = {r["doc_id"] for r in nj.keep_first(spark, spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, lang string"), "").collect()}
    assert kept == {i for i, _, c, _ in brute(data) if i == c}
    assert nj.keep_first(spark, none(spark), "").columns == docs(spark).columns


def test_pipeline_stage_shuffles_no_text_that_stays(spark):
    """Rows that the join shuffles are those dropped and a few more, and null and repeated ids stay."""
    data = corpus(7, 120) + [(None, "no id"), (None, None), (500, "twice"), (500, "twice")]
    kept = nj.keep_first(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(3), "")
    first = [(i, t) for (i, t), (_, _, c, _) in zip(sorted(data, key=str), sorted(((i, 0, c, 0) for i, _, c, _ in brute(data)), key=str), strict=True) if i == c]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(first, key=str)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join LeftAnti") :]
    assert plan.index("Union") < plan.index("Join LeftAnti") and "in_table" in plan and "Filter pythonUDF" in joined[: joined.index("LogicalRDD")]



def test_prefix_length():
    n = np.arange(0, 50)
    for k in range(1, 50):
        assert nj.prefix_length(n)[k] == k - -(-75 * k // 100) + 1
    assert nj.prefix_length(n)[0] == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = {(x, root(x)) for a, b in pairs if a != b for x in (a, b)}
    assert {tuple(r) for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_large_cluster(spark):
    """Near copies of one text: shuffled members grow with the blocks, and each block pair is a task."""
    rng = np.random.default_rng(5)
    words = rng.choice([f"w{i}" for i in range(5000)], 120).tolist()
    data = []
    for i in range(1500):
        t = list(words)
        t[int(rng.integers(len(t)))] = f"x{rng.integers(700)}"
        data.append((i, " ".join(t)))
    sets = [shingles(t) for _, t in data]
    names = {h: k for k, h in enumerate(sorted({x for s in sets for x in s}))}
    m = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        m[i, [names[h] for h in s]] = 1
    both, n = m @ m.T, m.sum(1)
    linked = 100 * both >= 75 * (n[:, None] + n - both)
    got = {r["doc_id"]: r for r in nj.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), block=400).collect()}
    assert [got[i]["n_links"] for i in range(len(sets))] == (linked.sum(1) - 1).tolist()
    assert {r["component_id"] for r in got.values()} == {0}


def test_bitmap_has_no_false_negative(spark):
    ids = spark.range(0, 3_000_000_000, 1_000_003)
    for bits in (None, 12, 20):
        table = common.bitmap(ids, bits)
        assert table.has(pa.array(np.arange(0, 3_000_000_000, 1_000_003))).all() and len(table.data) == 1 << table.bits - 3
    assert table.has(pa.array(np.arange(7, 3_000_000_000, 1_000_003))).mean() < 0.01
    assert not common.bitmap(ids.where("id < 0")).data.any()


def test_usual_counters_are_not_salted():
    level = np.full(1 << 10, 80, np.uint8)  # about a million each
    level[7] = 120
    got = nj.salts(level, 1 << 16)
    assert got[7] == nj.MOST_SALTS and (np.delete(got, 7) == 1).all()
