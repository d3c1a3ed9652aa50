"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut into chunks of it.
Chunks are dealt by hash into blocks of at most ``block_rows``; a block is
packed by itself, longest chunk first: each goes into the open bin it fills
best; if none has room, the permitted length of least cost per token that it
can still be filled with is opened. Every block is packed once under that
rule and once with each permitted length as the preferred one; then each bin is downsized to
the smallest permitted length that holds its contents, and the cheapest of the
packings is kept. The cost of a sequence of length c is
``c + overhead + c * c / quadratic``.

Only ids and lengths are shuffled. Memory is bounded by the block, also where
one id holds many rows: a partition is packed block after block.

Defined results: a text without words (null and empty included) gives one row
with 0 tokens and no bin; every token of every other text is in exactly one
bin; rows with equal ids are packed one by one; an empty table gives an empty
result. Other input columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTHS = (256, 512, 1024, 2048, 4096)
SCHEMA = "doc_id long, chunk long, first_token long, n_tokens long, bin_id long, bin_capacity long, bin_offset long"


def cost(c: int, overhead: float, quadratic: float) -> float:
    return c + overhead + c * c / quadratic


def _fill(sizes: list[int], lengths: tuple[int, ...], preferred: int | None, overhead: float, quadratic: float) -> tuple[float, list[tuple[int, int]], list[int]]:
    """Total cost, (bin, offset) of each size, and the bins' lengths. Sizes come in descending order."""
    left = sum(sizes)
    open_bins: list[tuple[int, int]] = []
    used: list[int] = []
    places = []
    for n in sizes:
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            fits = [c for c in lengths if c >= n]
            if preferred is None:
                room = min(fits, key=lambda c: (cost(c, overhead, quadratic) / min(c, left), c))
            else:
                room = max(preferred, fits[0])
            b = len(used)
            used.append(0)
        places.append((b, used[b]))
        used[b] += n
        left -= n
        if room > n:
            insort(open_bins, (room - n, b))
    final = [next(c for c in lengths if c >= u) for u in used]
    return sum(cost(c, overhead, quadratic) for c in final), places, final


def pack_block(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: float = 64, quadratic: float = 32768) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each size, in the order given, and the bins' lengths."""
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    down = [sizes[i] for i in order]
    _, places, final = min((_fill(down, lengths, p, overhead, quadratic) for p in (None, *lengths)), key=lambda x: x[0])
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i, place in zip(order, places, strict=True):
        out[i] = place
    return out, final


def pack(docs: DataFrame, n_tokens: Column, id_col: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, overhead: float = 64, quadratic: float = 32768, block_rows: int = 1 << 14) -> DataFrame:
    """One row for each chunk: its document, first token, tokens, bin, the bin's length and its place there."""
    top = max(lengths)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(n_tokens, F.lit(0)).cast("long").alias("n"))
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)).cast("long"))).alias("chunk"))
    pieces = pieces.select("doc_id", "chunk", (F.col("chunk") * top).alias("first_token"), F.least(F.lit(top), F.col("n") - F.col("chunk") * top).cast("long").alias("n_tokens"))
    pieces = common.cut(pieces)
    blocks = max(1, -(-pieces.count() // block_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                piece = batch.slice(at, block_rows)
                while len(piece):
                    held.append(piece.slice(0, block_rows - size))
                    piece = piece.slice(block_rows - size)
                    size += len(held[-1])
                    if size == block_rows:
                        yield packed(held, part << 40 | block << 20)
                        block, held, size = block + 1, [], 0
        if held:
            yield packed(held, part << 40 | block << 20)

    def packed(held: list[pa.RecordBatch], base: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        sizes = rows["n_tokens"].to_pylist()
        full = [i for i, n in enumerate(sizes) if n]
        places, final = pack_block([sizes[i] for i in full], lengths, overhead, quadratic)
        bins, capacity, offset = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
        for i, (b, o) in zip(full, places, strict=True):
            bins[i], capacity[i], offset[i] = base | b, final[b], o
        new = [pa.array(x, pa.int64()) for x in (bins, capacity, offset)]
        names = ["doc_id", "chunk", "first_token", "n_tokens", "bin_id", "bin_capacity", "bin_offset"]
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0) for c in names[:4]), *new], names=names)

    nameless = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # rows without an id are dealt by their place, not all to one block
    dealt = pieces.withColumn("h", F.xxhash64("doc_id", "chunk", "n_tokens", nameless)).repartition(blocks, "h").sortWithinPartitions("h", "doc_id", "chunk", "n_tokens")
    return dealt.select("doc_id", "chunk", "first_token", "n_tokens").mapInArrow(run, SCHEMA)


def words(text_col: str = "text") -> Column:
    """Number of white-space words."""
    return F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), words())


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: sequences of the documents that are left."""
    return pack(docs, words())
