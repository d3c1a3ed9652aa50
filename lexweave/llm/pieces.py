"""SentencePiece segmentation by sampling, and lossless decoding.

A text's segmentations form a lattice over its characters. Forward filtering
sums the weights of all ways to reach each character; backward sampling then draws one
piece after the other from the end, each in proportion to the weight of
all segmentations that end in it. Random numbers are a function of
(seed, row key, place), so a row always gets the same segmentation.

No piece goes from a letter on to a space, and a character that is in no longer
piece stands alone; so the lattice falls into units at these places, and
the filter runs once for each different unit a worker meets (a bounded table keeps
them) while every occurrence draws by itself. Piece weights: a unigram model's scores are log probabilities; the scores
of a BPE model are ranks and are read as Zipf weights, 1 / (rank + 10). ``alpha``
sharpens (above 1) or flattens the distribution.

As in the model's own encoder a space is put before the text and characters
outside the vocabulary become bytes. The character that stands for a space in
pieces becomes bytes as well where a text holds it, so decoding is lossless for every text.

Defined results: a null text has null ids and is decoded as null; an empty
one has no ids; a null row key draws as key -1; repeated rows are segmented alike; an empty table gives
an empty result. Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .toxicity import Lookup

SPACE = 0x2581
#: Stands in the lattice for the space character of pieces where the text itself holds it.
LITERAL = 0x110000
#: No edge.
NONE = np.iinfo(np.int32).min
#: Characters a chunk has, and what a worker's table of units holds at most.
STEP = 1 << 17
PLACES = 1 << 21
EDGES = 1 << 22


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces and weights; ``steps`` is a trie over them: from (node, character) to the next node, whose piece, or -1, is ``piece_of``."""

    pieces: list[bytes]
    byte_ids: np.ndarray
    weights: np.ndarray
    longest: int
    steps: tuple[np.ndarray, np.ndarray]
    piece_of: np.ndarray
    joined: np.ndarray

    @classmethod
    def load(cls, path: str, alpha: float = 1.0) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        scores = np.array([sp.get_score(i) for i in range(n)])
        normal = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)])
        ranks = bool((scores == np.round(scores)).all())
        order = np.empty(n)
        order[np.argsort(-scores, kind="stable")] = np.arange(n)
        weights = alpha * (-np.log(order + 10) if ranks else scores)
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        weights[byte_ids] = weights[normal].min()
        texts = [sp.id_to_piece(i) for i in range(n)]
        pieces = [t.replace("▁", " ").encode() if normal[i] else b"" for i, t in enumerate(texts)]
        for b, i in enumerate(byte_ids):
            pieces[i] = bytes([b])
        trie: dict[tuple[int, int], int] = {}
        piece_of = [-1]
        for i in np.flatnonzero(normal).tolist():
            node = 0
            for c in texts[i]:
                step = trie.setdefault((node, ord(c)), len(piece_of))
                if step == len(piece_of):
                    piece_of.append(-1)
                node = step
            piece_of[node] = i
        steps = np.array([node << 21 | c for node, c in trie], np.uint64), np.array(list(trie.values()))
        own = [t for t, k in zip(texts, normal, strict=True) if k]
        inner = {ord(c) for t in own if len(t) > 1 for c in t} | {SPACE}
        return cls(pieces, byte_ids, weights, max(map(len, own)), steps, np.array(piece_of, np.int32), np.array(sorted(inner), np.uint32))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def lattices(self) -> Lattices:
        """The units this process has met."""
        if not hasattr(self, "_lattices"):
            self._lattices = Lattices(self)
        return self._lattices


def _units(codes: np.ndarray, text_start: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Where units begin."""
    alone = ~joined[codes]
    space = codes == SPACE
    begin = np.zeros(len(codes), bool)
    begin[text_start] = True
    begin[1:] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    return np.flatnonzero(begin)


class Lattices:
    """Filtered lattices of units, kept in a table of at most ``PLACES`` places and ``EDGES`` edges (or of what one chunk needs) that is emptied when full.

    A unit has a place after each of its characters; the edges into a place
    are pieces by length, each with the probability that the drawn one is it
    or a shorter one. All of it is a function of the unit alone, so a draw
    doesn't depend on what else the table holds.
    """

    def __init__(self, voc: Vocabulary):
        self.weights, self.longest, self.byte_weight = voc.weights, voc.longest, voc.weights[voc.byte_ids[0]]
        self.joined = np.zeros(LITERAL + 1, bool)
        self.joined[voc.joined] = True
        keys, nodes = voc.steps
        self.root = np.zeros(LITERAL + 1, np.int32)
        self.root[keys[keys < 1 << 21].astype(np.int64)] = nodes[keys < 1 << 21]
        self.steps, self.piece_of = Lookup(keys, nodes), voc.piece_of
        self._empty(0, 0)

    def _empty(self, places: int, edges: int) -> None:
        self.number: dict[int, int] = {}
        self.places = self.edges = 0
        self.first = np.empty(max(PLACES, places) + 1, np.int32)
        self.upto = np.empty(max(EDGES, edges))
        self.piece = np.empty(max(EDGES, edges), np.int32)
        self.span = np.empty(max(EDGES, edges), np.uint8)

    def find(self, names: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first place of each unit, given by its hash and its part of codes."""
        known = self.number
        at = np.fromiter((known.get(n, -1) for n in names.tolist()), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            new = new[np.argsort(size[new], kind="stable")]
            built = self._build(codes, start[new], size[new])
            if self.places + len(built[0]) >= len(self.first) or self.edges + len(built[1]) > len(self.upto):
                new = np.argsort(size, kind="stable")
                built = self._build(codes, start[new], size[new])
                self._empty(len(built[0]), len(built[1]))
            at[new] = self._append(names[new], size[new], *built)
        return at

    def _append(self, names: np.ndarray, size: np.ndarray, first: np.ndarray, upto: np.ndarray, piece: np.ndarray, span: np.ndarray) -> np.ndarray:
        base = self.places + np.cumsum(size) - size
        self.number.update(zip(names.tolist(), base.tolist(), strict=True))
        self.first[self.places : self.places + len(first)] = first + self.edges
        for whole, part in ((self.upto, upto), (self.piece, piece), (self.span, span)):
            whole[self.edges : self.edges + len(part)] = part
        self.places += len(first)
        self.edges += len(upto)
        return base

    def _build(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """(first edge of each place; probability up to, piece and length of each edge) of units in order of size, block by block of about STEP characters or one longer unit."""
        block = (np.cumsum(size) - 1) // STEP * 3 + np.searchsorted([6, 10], size)
        cuts = np.searchsorted(block, np.unique(block)).tolist() + [len(size)]
        built = [self._filter(codes, start[a:b], size[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        edges = np.cumsum([0, *(len(b[1]) for b in built)])
        built = [(b[0] + e, *b[1:]) for b, e in zip(built, edges, strict=False)]
        return [np.concatenate(c) for c in zip(*built, strict=True)]

    def _filter(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        base = np.cumsum(size) - size
        offset = np.arange(int(size.sum())) - np.repeat(base, size)
        own = codes[np.repeat(start, size) + offset]
        left = np.repeat(size, size) - offset
        into = np.full((len(own), min(self.longest, int(size[-1]))), NONE, np.int32)  # the piece of each length that ends at a place
        at = np.arange(len(own))
        node = self.root[own]
        into[:, 0] = np.where(self.piece_of[node] >= 0, self.piece_of[node], -own.astype(np.int32) - 1)
        for n in range(2, into.shape[1] + 1):
            more = (node > 0) & (left[at] >= n)
            at, node = at[more], node[more]
            if not len(at):
                break
            hit, step = self.steps.get(node.astype(np.uint64) << np.uint64(21) | own[at + n - 1])
            at, node = at[hit], step[hit].astype(np.int32)
            is_piece = self.piece_of[node] >= 0
            into[at[is_piece] + n - 1, n - 1] = self.piece_of[node[is_piece]]
        upto = np.where(into >= 0, self.weights[np.maximum(into, 0)], -np.inf)
        spelt = into[:, 0] < 0
        upto[spelt, 0] = self.byte_weight * _width(own[spelt])
        forward = np.zeros(len(own) + len(size))
        zero = base + np.arange(len(size))
        shorter = np.searchsorted(size, np.arange(int(size[-1]) + 1))
        for depth in range(1, int(size[-1]) + 1):
            m = min(depth, upto.shape[1])
            row, place = base[shorter[depth] :] + depth - 1, zero[shorter[depth] :] + depth
            score = upto[row, :m] + forward[place[:, None] - np.arange(1, m + 1)]
            top = score.max(axis=1)
            total = np.cumsum(np.exp(score - top[:, None]), axis=1)
            forward[place] = top + np.log(total[:, -1])
            upto[row, :m] = total / total[:, -1:]
        row, span = np.nonzero(into != NONE)
        last = np.append(row[1:] != row[:-1], True)
        return np.searchsorted(row, np.arange(len(own))), np.where(last, 1.0, upto[row, span]), into[row, span], (span + 1).astype(np.uint8)


def _width(codes: np.ndarray) -> np.ndarray:
    c = np.where(codes == LITERAL, SPACE, codes)
    return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)


def sample(texts: list[str | None], keys: np.ndarray, voc: Vocabulary, seed: int = 1) -> list[np.ndarray | None]:
    """Ids of each text; keys seed the rows."""
    filled = [i for i, t in enumerate(texts) if t]
    out: list[np.ndarray | None] = [None if t is None else np.zeros(0, np.int32) for t in texts]
    if not filled:
        return out
    own = [np.frombuffer((" " + texts[i]).encode("utf-32-le", "surrogatepass"), np.uint32) for i in filled]
    codes = np.concatenate(own)
    text_start = np.cumsum([0, *map(len, own)])[:-1]
    codes = np.where(codes == SPACE, LITERAL, np.where(codes == 32, SPACE, codes)).astype(np.uint32)
    known = voc.lattices()
    begin = _units(codes, text_start, known.joined)
    size = np.diff(np.append(begin, len(codes)))
    offset = np.arange(len(codes)) - np.repeat(begin, size)
    name = np.add.reduceat(common.mix(codes.astype(np.uint64) | offset.astype(np.uint64) << np.uint64(21)), begin) ^ common.mix(size)
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    base = known.find(name[first], codes, begin[first], size[first])[which]
    text = np.searchsorted(text_start, begin, "right") - 1
    rows = common.mix(keys[filled].astype(np.int64).view(np.uint64) ^ common.mix(np.array([seed], np.uint64)))
    nth = np.arange(len(begin)) - np.searchsorted(text, np.arange(len(filled)))[text]
    state = common.mix(rows[text] + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    at = base + size - 1
    alive = np.arange(len(begin))
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    while len(alive):
        u = (common.mix(state[alive] + np.uint64((len(drawn) + 1) * 0x8CB92BA72F3D8DD7 % 2**64)) >> np.uint64(11)).astype(float) / 2.0**53
        edge = known.first[at[alive]]
        beyond = np.flatnonzero(known.upto[edge] < u)
        while len(beyond):
            edge[beyond] += 1
            beyond = beyond[known.upto[edge[beyond]] < u[beyond]]
        drawn.append((alive, known.piece[edge]))
        at[alive] -= known.span[edge]
        alive = alive[at[alive] >= base[alive]]
    count = np.zeros(len(begin), np.int64)
    for a, _ in drawn:
        count[a] += 1
    offset = np.cumsum(count) - count
    ids = np.empty(int(count.sum()), np.int64)
    for step, (a, p) in enumerate(drawn):
        ids[offset[a] + count[a] - 1 - step] = p
    owner = np.repeat(text, count)
    ids, owner = _spell(ids, owner, voc)
    cut = np.searchsorted(owner, np.arange(len(filled) + 1))
    for k, i in enumerate(filled):
        out[i] = ids[cut[k] : cut[k + 1]]
    return out


def _spell(ids: np.ndarray, owner: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Characters that stand for their bytes become byte pieces."""
    spelt = np.flatnonzero(ids < 0)
    if not len(spelt):
        return ids.astype(np.int32), owner
    codes = -ids[spelt] - 1
    codes = np.where(codes == LITERAL, SPACE, codes)
    wide = np.ones(len(ids), np.int64)
    wide[spelt] = _width(codes)
    start = np.cumsum(wide) - wide
    out = np.repeat(ids, wide).astype(np.int32)
    n = wide[spelt]
    for k in range(1, 5):
        of, c = start[spelt[n == k]], codes[n == k]
        for b in range(k):
            lead = c if k == 1 else ((0xF00 >> k & 0xFF) | c >> 6 * (k - 1)) if b == 0 else 0x80 | (c >> 6 * (k - 1 - b) & 0x3F)
            out[of + b] = voc.byte_ids[lead]
    return out, np.repeat(owner, wide)


def decode_ids(ids: np.ndarray, voc: Vocabulary) -> str:
    pieces = voc.pieces
    return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8")[1:]


def _key_array(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """doc_id and ids of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model(), alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _key_array(batch.column(0))
            for start, part in common.chunks(batch.column(1).to_pylist(), STEP):
                ids = sample(part, keys[start : start + len(part)], shared.value, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode_ids(np.array(ids, np.int32), shared.value) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def segment_digests(docs: DataFrame, model: str | None = None, seed: int = 1) -> DataFrame:
    """doc_id, n_ids, a digest of the ids, and whether decoding gives the text back, without sending the ids on."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _key_array(batch.column(0))
            for start, part in common.chunks(batch.column(1).to_pylist(), STEP):
                ids = sample(part, keys[start : start + len(part)], shared.value, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(part)),
                        pa.array([None if x is None else len(x) for x in ids], pa.int64()),
                        pa.array([None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([None if x is None else decode_ids(x, shared.value) == t for x, t in zip(ids, part, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_ids", "ids_sha256", "lossless"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, lossless boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_digests(common.table(spark, sf_dir, "documents"))
