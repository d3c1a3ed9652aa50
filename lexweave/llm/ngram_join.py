"""Near duplicates by a grouped prefix join on word shingles, exactly.

A document's set holds its different five-word shingles, as 64-bit hashes.
Two documents link when their sets' Jaccard similarity is at least
``percent`` / 100.

1. Shingles get a global order: rare before frequent, by a counted table of
   2**SKETCH_BITS counters over all documents (any order would be right; this one
   keeps passages that many documents share out of the prefixes).
2. A set of n shingles that links with another shares one of its
   n - ceil(n * percent / 100) + 1 first shingles with the other's first ones.
   Documents with equal prefixes and sizes are one group; groups that share a
   prefix shingle, at places that leave room for enough others in common, are paired, WINDOW at once; where more
   share one, they hang on to one of them, star by star, without making pairs.
   Shingles that are very frequent by the table are salted.
   A pair stays if the parity tables of the two sets, of at least a bit a shingle, differ in no more bits than linked
   sets can. So texts that merely share passages don't grow into clusters that hold most of a large table.
   What stays and the stars make the clusters.
3. Of every different set in a cluster one document is loaded. Group pairs
   are filtered by size and by how many prefix shingles they share; then their members are
   expanded and every pair is verified exactly. Clusters over
   BLOCK documents or BLOCK_SHINGLES shingles are compared block by block, each pair of blocks by a task of its
   own, so no task holds more than two blocks.
4. A task gives the number of links of each set, copies counted, and links that connect what is connected
   (fewer than its documents). These are closed to components; equal sets follow their representative.

Result: one row for each document with the size of its set, the smallest
id that links reach, and the number of other rows it links to.

Defined results: null, empty and wordless texts have size 0 and are their own
component; a text of one to four words is a single shingle; a null id has a
null component and links with nothing; rows with equal ids count as one
document, linked by any of their texts, but each row's number of links is that of its own text; an empty table gives an empty result.
Other input columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph
from .quality import span_hashes

WORDS = 5
PERCENT = 75
SKETCH_BITS = 21
#: Frequency classes in a quarter of a power of two.
FINE = 16
BLOCK = 2048
BLOCK_SHINGLES = 1_000_000
SALT_ROWS = 1 << 16
MOST_SALTS = 256
#: Groups that share a prefix shingle and leave room for the next are paired one by one up to so many.
WINDOW = 64
#: Parts a cluster's rows are dealt to where its size is joined to them.
SPREAD = 8
#: Lower-cases A to Z; the white space that parts words becomes a space.
LOWER = bytes(32 if c in (32, 9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of every text's different shingles, ordered by both."""
    parts = [(t or "").encode("utf-8", "replace").translate(LOWER) for t in texts]
    size = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    raw = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    inside = raw != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2] + 1, edge[1::2] + 1
    w = span_hashes(raw, begin, end)
    at = np.searchsorted(begin, np.concatenate([[0], np.cumsum(size)]) + 1)
    n = np.diff(at)
    k = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), k)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + at[:-1][doc]
    last = at[1:][doc]
    h = np.zeros(len(doc), np.uint64)
    for i in range(WORDS):
        there = place + i < last
        h = np.where(there, common.mix(h * np.uint64(3) ^ w[np.minimum(place + i, len(w) - 1)]), h) if len(w) else h
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[new], h[new]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n + (-n * PERCENT) // 100 + 1, 0)


class Sets:
    """The sets of some texts, each in the global order, with prefixes and group keys."""

    def __init__(self, texts: list[str | None], level: np.ndarray):
        doc, h = shingle_sets(texts)
        self.n = np.bincount(doc, minlength=len(texts))
        self.start = np.cumsum(self.n) - self.n
        self.by_hash = h
        order = np.lexsort((h, level[bucket(h)], doc))
        self.ordered = h[order]
        self.p = prefix_length(self.n)
        rank = np.arange(len(doc)) - self.start[doc]
        self.in_prefix = rank < self.p[doc]
        self.doc = doc
        mixed = common.mix(h)
        self.k1 = self._sum(mixed, doc, len(texts))
        self.k2 = self._sum(common.mix(mixed ^ np.uint64(0xA0761D6478BD642F)), doc, len(texts))
        own = self._sum(common.mix(self.ordered[self.in_prefix] ^ np.uint64(0xE7037ED1A0B428DB)), doc[self.in_prefix], len(texts))
        self.gid = common.mix(own + self.n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    @staticmethod
    def _sum(values: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
        """Sums modulo 2**64 by document."""
        total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        n = np.bincount(doc, minlength=size)
        end = np.cumsum(n)
        return total[end] - total[end - n]

    def of(self, i: int) -> np.ndarray:
        return self.by_hash[self.start[i] : self.start[i] + self.n[i]]

    def prefix(self, i: int) -> np.ndarray:
        return self.ordered[self.start[i] : self.start[i] + self.p[i]]


def order_levels(docs: DataFrame) -> np.ndarray:
    """Frequency class of each counter: one of FINE * 4 classes a power of two, as every counter is a sum of many shingles and a rare one differs little from a frequent one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, run in common.chunks(batch.column(0).to_pylist()):
                seen += np.bincount(bucket(shingle_sets(run)[1]), minlength=1 << SKETCH_BITS)
        yield common.table_rows({"seen": seen}, 1 << 14)

    total = common.summed_tables(docs.select("text").mapInArrow(count, common.TABLE_SCHEMA), 1 << SKETCH_BITS, 1 << 14).get("seen", np.zeros(1 << SKETCH_BITS, np.int64))
    return np.floor(np.log2(np.maximum(total, 1)) * 4 * FINE).astype(np.uint16)


def salts(level: np.ndarray, rows: int) -> np.ndarray:
    """Parts that a counter's shingles are dealt to, by how far it is above what most counters hold; ``level`` in quarters of a power of two."""
    count = 2.0 ** ((level.astype(float) + 1) / 4)
    usual = np.median(count) if level.any() else 0.0
    return np.clip(np.ceil((count - 2 * usual) / rows), 1, MOST_SALTS).astype(np.int64)


def clusters(sets: DataFrame, classes: DataFrame, level, salt_rows: int, window: int = WINDOW) -> DataFrame:
    """(node, component) of groups that share a prefix shingle, at places and with sizes that leave room for enough others, and that aren't told apart by their parity tables; ``sets``: n, gid, prefix, parity; ``classes``: the gid of every different set."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = salts(level.value // FINE, salt_rows)
        linked: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), 4096):
                n, group = (batch.column(i).slice(at, 4096).to_numpy() for i in range(2))
                prefix = batch.column(2).slice(at, 4096).to_pylist()
                size = np.array([len(p) // 8 for p in prefix], np.int64)
                token = np.frombuffer(b"".join(prefix), "<u8").copy()
                gid = np.repeat(group, size)
                where = (np.repeat(n, size) << 32) | (np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size))
                many = salt[bucket(token)]
                hot = np.flatnonzero(many > 1)
                part = common.mix(gid[hot].view(np.uint64)) % many[hot].astype(np.uint64)
                plain = token[hot].copy()
                token[hot] = common.mix(plain + part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                where[hot] = 0
                also = []
                for k, key in enumerate(token[hot].tolist()):
                    if key not in linked:
                        linked.add(key)
                        also.append(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([token, plain[also]]).view(np.int64)), pa.array(np.concatenate([where, where[hot][also]])), pa.array(np.concatenate([gid, gid[hot][also]]))], names=["token", "at", "gid"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a token come by size. Each group meets those before it that leave room for it; of more than ``window`` at once, or of a salted token, all hang on to one until none accepts the size of the next."""
        token, live, hub, top = None, [], None, -1
        for batch in batches:
            t, at, g = (c.to_numpy() for c in batch.columns)
            if not len(t):
                continue
            same = t[1:] == t[:-1]
            alone = ~np.append(same, True) & ~np.append(t[0] == token, same)  # its token isn't next to it; the last row may go on
            pairs: set[tuple[int, int]] = set()
            stars: set[tuple[int, int]] = set()
            for k in np.flatnonzero(~alone).tolist():
                n, i, own = int(at[k]) >> 32, int(at[k]) & 0xFFFFFFFF, int(g[k])
                if t[k] != token:
                    token, live, hub = t[k], [], None
                # sets of n and m shingles whose first common one is at place i of the first hold at most n - i in common
                room = (100 + PERCENT) * (n - i) - PERCENT * n
                if hub is not None and PERCENT * n <= top:
                    if own != hub:
                        stars.add((own, hub))
                    top = max(top, room)
                    continue
                hub = None
                live = [x for x in live if PERCENT * n <= x[0]]
                if any(x[2] == own for x in live):
                    continue
                pairs.update((min(own, x[2]), max(own, x[2])) for x in live if PERCENT * x[1] <= room)
                live.append((room, n, own))
                if len(live) > window or n == 0:
                    hub, top = live[0][2], max(x[0] for x in live)
                    stars.update((x[2], hub) for x in live[1:])
                    live = []
            for found, star in ((pairs, False), (stars, True)):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([star] * len(found), pa.bool_())], names=["a", "b", "star"])

    posted = sets.where("prefix IS NOT NULL").select("n", "gid", "prefix").mapInArrow(postings, "token long, at long, gid long")
    dealt = posted.repartition(common.shuffle_width(sets.sparkSession), "token").sortWithinPartitions("token", "at", "gid")
    met = common.cut(dealt.mapInArrow(meet, "a long, b long, star boolean").groupBy("a", "b").agg(F.max("star").alias("star")))
    return graph.components(met.where("star").select("a", "b").unionByName(close(met.where("NOT star").select("a", "b"), sets, classes)))


def close(pairs: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs of groups (a, b) that may link: bits in which their parity tables differ are elements that one set alone has. Groups of several different sets stay."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = batch.columns
            most = (100 - PERCENT) * (n.to_numpy() + m.to_numpy()) // (100 + PERCENT)  # elements that only one of two linked sets has
            keep = differing(x.to_pylist(), y.to_pylist()) <= most
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    told = sets.where("prefix IS NOT NULL").groupBy("gid").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
    single = classes.groupBy("gid").agg(F.count("*").alias("kinds"))
    tables = told.join(single, "gid").select("gid", "n", F.when(F.col("kinds") == 1, F.col("parity")).alias("parity"))
    first, second = tables.toDF("a", "n", "x"), tables.toDF("b", "m", "y")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(differ, "a long, b long")


def parity_tables(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set a table of at least n bits, in bytes: each element turns one bit over. Tables of half the size are the two halves of a table, one turned over by the other."""
    bits = 1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
    place = (common.mix(h ^ np.uint64(0x8EBC6AF09C88C6E3)) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    start = np.cumsum(bits) - bits
    odd = np.bincount(start[doc] + place, minlength=int(bits.sum())).astype(np.uint8) & 1
    packed = np.packbits(odd).tobytes()
    return [packed[s : s + b] for s, b in zip((start >> 3).tolist(), (bits >> 3).tolist(), strict=True)]


def differing(x: list[bytes | None], y: list[bytes | None]) -> np.ndarray:
    """The number of bits in which parity tables differ, those of the smaller size; 0 where one isn't known."""
    out = np.zeros(len(x), np.int64)
    kinds: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        if a is not None and b is not None:
            kinds[len(a), len(b)].append(i)
    for size, rows in kinds.items():
        both = [np.frombuffer(b"".join(z[i] for i in rows), np.uint8).reshape(len(rows), w) for z, w in zip((x, y), size, strict=True)]
        for k in range(2):
            while both[k].shape[1] > min(size):
                half = both[k].shape[1] // 2
                both[k] = both[k][:, :half] ^ both[k][:, half:]
        out[rows] = np.bitwise_count(both[0] ^ both[1]).sum(1, dtype=np.int64)
    return out


def link_members(ids: list[int], blocks: list[int], copies: list[int], s: Sets) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links among different blocks (or within the only one): a spanning forest of them, and of each set the number of documents it links to.

    ``copies``: how many documents have each set. A set and the members of one
    group that pass the filters are compared at once.
    """
    cross = len(set(blocks)) > 1
    block = np.array(blocks)
    weight = np.array(copies, np.int64)
    count = np.zeros(len(ids), np.int64)
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    groups: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(ids)), key=lambda i: (int(s.n[i]), ids[i])):
        groups[int(s.gid[i])].append(i)
    members = [np.array(m) for m in groups.values()]
    n_of = np.array([s.n[m[0]] for m in members])
    p_of = np.array([s.p[m[0]] for m in members])
    names, token = np.unique(s.by_hash, return_inverse=True)
    mark = np.zeros(len(names), bool)
    index: dict[int, list[int]] = defaultdict(list)
    links = []

    def verify(x: int, others: np.ndarray) -> None:
        if cross:
            others = others[block[others] != block[x]]
        own = token[s.start[x] : s.start[x] + s.n[x]]
        mark[own] = True
        for at in range(0, len(others), 256):
            y = others[at : at + 256]
            n = s.n[y]
            places = np.repeat(s.start[y] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            shared = np.add.reduceat(mark[token[places]], np.cumsum(n) - n, dtype=np.int64)
            found = y[100 * shared >= PERCENT * (n + s.n[x] - shared)]
            count[x] += weight[found].sum()
            count[found] += weight[x]
            for o in found.tolist():
                if root(x) != root(o):
                    up[root(x)] = root(o)
                    links.append((ids[x], ids[o]))
        mark[own] = False

    for g, own in enumerate(members):
        tokens = s.prefix(own[0]).tolist()
        found = [index[t] for t in tokens if t in index]
        near = []
        if found:
            other, shared = np.unique(np.concatenate(found), return_counts=True)
            need = -(-PERCENT * (n_of[g] + n_of[other]) // (100 + PERCENT))
            rest = np.maximum(n_of[g] - p_of[g], n_of[other] - p_of[other])
            ok = (100 * n_of[other] >= PERCENT * n_of[g]) & (shared + rest >= need)
            near = [members[o] for o in other[ok].tolist()]
        for k, x in enumerate(own.tolist()):
            if len(others := np.concatenate([*near, own[:k]])):
                verify(x, others)
        for t in tokens:
            index[t].append(g)
    return links, count


def verified_links(docs: DataFrame, tasks: DataFrame, level) -> DataFrame:
    """Links (a, b) and, with a null b, numbers of links of a from tasks (doc_id, k1, copies, cluster, block, i, j): the documents of a task are loaded together."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(common.bitmap(tasks.select("doc_id")))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.has(batch.column(0))))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, str]] = []
        key = None
        for batch in batches:
            for *k, doc, k1, copies, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and held:
                    yield links(held)
                    held = []
                key = k
                held.append((doc, k1, copies, b, text))
        if held:
            yield links(held)

    def links(held: list[tuple[int, int, int, int, str]]) -> pa.RecordBatch:
        s = Sets([h[4] for h in held], level.value)
        own = {(h[0], h[1]): i for i, h in enumerate(held) if s.k1[i].view(np.int64) == h[1]}  # other texts under the same id fall out
        if len(own) < len(held):
            held = [held[i] for i in sorted(own.values())]
            s = Sets([h[4] for h in held], level.value)
        found, count = link_members([h[0] for h in held], [h[3] for h in held], [h[2] for h in held], s)
        has = np.flatnonzero(count)
        a = [x[0] for x in found] + [held[i][0] for i in has]
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array([x[1] for x in found] + [None] * len(has), pa.int64()), pa.array([0] * len(found) + [held[i][1] for i in has], pa.int64()), pa.array([0] * len(found) + count[has].tolist(), pa.int64())],
            names=["a", "b", "k1", "n_links"],
        )

    texts = docs.select("doc_id", "text").mapInArrow(some, "doc_id long, text string")
    loaded = texts.join(tasks, "doc_id").repartition(common.shuffle_width(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")
    return loaded.select("cluster", "i", "j", "doc_id", "k1", "copies", "block", "text").mapInArrow(solve, "a long, b long, k1 long, n_links long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, salt_rows: int = SALT_ROWS, window: int = WINDOW) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row."""
    spark = docs.sparkSession
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    level = spark.sparkContext.broadcast(order_levels(every))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for start, run in common.chunks(batch.column(1).to_pylist()):
                s = Sets(run, level.value)
                ids = batch.column(0).slice(start, len(run))
                prefix: list[bytes | None] = [None] * len(run)  # once a task for each group
                parity: list[bytes | None] = [None] * len(run)
                table = parity_tables(s.by_hash, s.doc, s.n)
                for i in np.flatnonzero((s.n > 0) & ~ids.is_null().to_numpy(zero_copy_only=False)).tolist():
                    if (g := int(s.gid[i])) not in told:
                        told.add(g)
                        prefix[i], parity[i] = s.prefix(i).astype("<u8").tobytes(), table[i]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(s.n.astype(np.int64)), pa.array(s.k1.view(np.int64)), pa.array(s.k2.view(np.int64)), pa.array(s.gid), pa.array(prefix, pa.binary()), pa.array(parity, pa.binary())],
                    names=["doc_id", "n", "k1", "k2", "gid", "prefix", "parity"],
                )

    sets = common.cut(every.mapInArrow(describe, "doc_id long, n long, k1 long, k2 long, gid long, prefix binary, parity binary"))
    known = every.where("doc_id IS NOT NULL")
    classes = common.cut(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("gid").alias("gid"), F.count("*").alias("copies")))
    near = clusters(sets, classes, level, salt_rows, window).select(F.col("node").alias("gid"), F.col("component").alias("near"))
    placed = classes.join(near, "gid", "left").select("rep", "k1", "n", "copies", F.coalesce("near", "gid").alias("cluster"), F.pmod(F.xxhash64("rep"), F.lit(SPREAD)).alias("spread"))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("all")).where("size > 1")
    sizes = sizes.select("cluster", F.ceil(F.greatest(F.col("size") / block, F.col("all") / BLOCK_SHINGLES)).cast("long").alias("blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("spread"))
    member = placed.join(sizes, ["cluster", "spread"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = common.cut(member.select(F.col("rep").alias("doc_id"), "k1", "copies", "cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    found = common.cut(verified_links(known, tasks, level))
    reached = graph.components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("rep"), "component")
    linked_to = found.where("b IS NULL").groupBy(F.col("a").alias("rep"), "k1").agg(F.sum("n_links").alias("others"))
    final = classes.join(reached, "rep", "left").join(linked_to, ["rep", "k1"], "left")
    final = final.select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    linked = sets.where("n > 0 AND doc_id IS NOT NULL").join(final, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = sets.where("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of the documents that links connect, the one of the smallest id stays, and those without an id."""
    gone = common.cut(near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct())
    table = spark.sparkContext.broadcast(common.bitmap(gone))

    @F.arrow_udf("boolean")
    def in_table(ids: pa.Array) -> pa.Array:
        return pa.array(table.value.has(ids))

    named = in_table(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))  # the others stay without a shuffle of their texts
    return docs.where(~named).unionByName(docs.where(named).join(gone, "doc_id", "left_anti").select(*docs.columns))


#: The same from all pairs that share a shingle, closed step by step.
OP2_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id, coalesce(l.n, 0) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = d.doc_id
"""
