"""Lexical retrieval packing.

Documents become pieces of token ids that fill windows of 4096.  A document's whole windows
stand alone; what is left over is packed with its lexical neighbours.  Left-overs are dealt to
shards in the order of their most telling tokens, so that neighbours meet; a shard keeps an
inverted index of BM25 weights of one block of them at a time, and a seed document asks it for
unused neighbours of its block, which fill
the seed's window in the order of their scores: those that fit whole first, then the best of
the rest gives as many ids as are free.  What remains of that one is the next seed.  So only
the last window of a shard is padded, and only to a power of two.

Token frequencies over all documents (at most 65,536 numbers) and the mean length are counted
first.  Shards are ranges of (tokens, hash of the document), never split by key alone, so a
third of all documents sharing their tokens fill as many shards as they need.  A task indexes
a million ids at a time and carries only an open window from block to block.

Defined cases: null and empty texts are the end id alone; repeated rows are documents of their
own; null ids stay null; ties in a score go to the earlier left-over; an empty table gives an
empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common, tokens
from gridloom.llm.words import bytes_of

WINDOW, END = 4096, 2
K1, B = 1.2, 0.75
BLOCK_IDS = 1 << 20
#: Left-overs whose tokens are sorted together for their signatures.
SIGNED_ROWS = 256
VOCABULARY = 1 << 16
#: Ids of a shard: at least the first; as many as the second once there are ``MANY`` shards.
SHARD_IDS, LARGE_SHARD_IDS, MANY = 2 << 20, 64 << 20, 4000

PIECE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint, seed boolean, ids binary"
)


def _rest(ids: bytes | pa.Buffer, window: int) -> np.ndarray:
    """What is left of a document after its whole windows."""
    found = np.frombuffer(ids, dtype="<u2")
    return found[len(found) // window * window :]


def _document_frequencies(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, total = np.zeros(VOCABULARY, dtype=np.int64), 0, 0
        place, turn = np.zeros(VOCABULARY, dtype=np.int64), np.arange(window)
        for batch in batches:
            for ids in batch.column(0):
                rest = _rest(ids.as_buffer(), window)
                # Each token leaves one of its places there: that one counts it.
                place[rest] = turn[: len(rest)]
                seen[rest[place[rest] == turn[: len(rest)]]] += 1
                docs += len(rest) > 0
                total += len(rest)
        at = np.flatnonzero(seen)
        # Places past the vocabulary: the number of left-overs and of their ids.
        terms = np.concatenate([at, [VOCABULARY, VOCABULARY + 1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.int32()), pa.array(np.concatenate([seen[at], [docs, total]]), pa.int64())], names=["term", "n"]
        )

    return count


class Weights:
    """BM25 weights of tokens, from counts over all left-overs."""

    def __init__(self, term: np.ndarray, n: np.ndarray):
        counts = np.zeros(VOCABULARY + 2)
        counts[term] = n
        docs, total = counts[VOCABULARY:]
        df = counts[:VOCABULARY]
        self.docs, self.total = int(docs), int(total)
        self.mean = max(total / max(docs, 1), 1.0)
        # Robertson's weight, not below 0: tokens of over half of all left-overs tell nothing.
        self.idf = np.maximum(np.log((docs - df + 0.5) / (df + 0.5)), 0.0).astype(np.float32)

    def impact(self, terms: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


def _signatures(weights, window: int):
    """The two most telling tokens of each left-over, for the order of the shards."""

    def best(score: np.ndarray, term: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
        """The token of the highest score of each left-over, -1 for those of fewer than ``least``
        tokens; equal scores: the smaller token.  Its score is made the lowest."""
        out = np.full(len(at) - 1, -1, dtype=np.int64)
        if not len(score):
            return out
        filled = np.flatnonzero(np.diff(at))
        count = np.diff(at)[filled]
        top = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, at[filled]), count))
        first = top[np.searchsorted(top, at[filled])]
        score[first] = -1.0
        out[filled] = np.where(count >= least, term[first], -1)
        return out

    def of(ids: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second token of left-overs of ``rest`` ids each; -1 for none."""
        owner = np.repeat(np.arange(len(rest)), rest)
        pairs, tf = np.unique(owner * VOCABULARY + ids, return_counts=True)
        doc, term = pairs // VOCABULARY, pairs % VOCABULARY
        score = weights.value.impact(term, tf, rest[doc])
        at = np.searchsorted(doc, np.arange(len(rest) + 1))
        return best(score, term, at, 1), best(score, term, at, 2)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytes_of(batch.column("ids"))
            ids, ends = raw.view("<u2"), offsets[1:] // 2
            rest = np.diff(offsets) // 2 % window
            first, second = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            # Some rows at a time: what is widened and sorted together stays small.
            for begin in range(0, len(rest), SIGNED_ROWS):
                rows = slice(begin, begin + SIGNED_ROWS)
                own = [ids[end - n : end] for end, n in zip(ends[rows].tolist(), rest[rows].tolist(), strict=True)]
                one, two = of(np.concatenate(own).astype(np.int64), rest[rows])
                first.append(one)
                second.append(two)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(first), pa.int32()), pa.array(np.concatenate(second), pa.int32())],
                names=[*batch.schema.names, "first", "second"],
            )

    return sign


class Shard:
    """Packs left-overs block by block; one window stays open between blocks."""

    def __init__(self, weights: Weights, window: int, first_sequence: int):
        self.weights, self.window = weights, window
        self.sequence, self.used = first_sequence, 0
        self.seed_terms: np.ndarray | None = None
        self.pieces: list[tuple] = []

    def piece(self, doc: tuple, start: int, ids: np.ndarray, seed: bool) -> None:
        doc_id, doc_tokens = doc
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        self.pieces.append(
            (doc_id, start, len(ids), crc, doc_tokens, self.sequence, self.used, seed, ids.tobytes())
        )
        self.used += len(ids)
        if self.used == self.window:
            self.sequence, self.used, self.seed_terms = self.sequence + 1, 0, None

    def block(self, docs: list[tuple], rests: list[np.ndarray], starts: list[int]) -> None:
        """Use up all left-overs of a block."""
        lengths = np.array([len(r) for r in rests], dtype=np.int64)
        owner = np.repeat(np.arange(len(rests), dtype=np.int64), lengths)
        pairs, tf = np.unique(owner * VOCABULARY + np.concatenate(rests), return_counts=True)
        doc, term = pairs // VOCABULARY, pairs % VOCABULARY
        bounds = np.searchsorted(doc, np.arange(len(rests) + 1))
        told = self.weights.idf[term] > 0
        by_term = np.flatnonzero(told)[np.argsort(term[told], kind="stable")]
        post_doc = doc[by_term]
        post_impact = self.weights.impact(term[by_term], tf[by_term], lengths[post_doc])
        post_at = np.searchsorted(term[by_term], np.arange(VOCABULARY + 1)).tolist()
        free, open_lengths, open_starts = np.ones(len(rests), dtype=bool), lengths.copy(), list(starts)
        next_free, cut = 0, -1
        while True:
            if self.used == 0:
                # A new window: what is left of the document that was cut, else the next in order.
                while next_free < len(rests) and not free[next_free]:
                    next_free += 1
                seed = cut if cut >= 0 else next_free
                if seed >= len(rests):
                    return
                self.seed_terms = term[bounds[seed] : bounds[seed + 1]]
                self.take(docs, rests, seed, open_lengths, open_starts, free, int(open_lengths[seed]), True)
                cut = -1
                if self.used == 0:
                    continue
            terms = self.seed_terms.tolist() if self.seed_terms is not None else []
            runs = [slice(post_at[t], post_at[t + 1]) for t in terms if post_at[t + 1] > post_at[t]]
            if runs:
                score = np.bincount(
                    np.concatenate([post_doc[r] for r in runs]),
                    weights=np.concatenate([post_impact[r] for r in runs]),
                    minlength=len(rests),
                )
            else:
                score = np.zeros(len(rests))
            score[~free] = -1.0
            while self.used:
                # The best of those that fit, the first of equals; scores are not negative.
                fits = np.where(open_lengths <= self.window - self.used, score, -1.0)
                taken = int(np.argmax(fits))
                if fits[taken] >= 0:
                    score[taken] = -1.0
                    self.take(docs, rests, taken, open_lengths, open_starts, free, int(open_lengths[taken]), False)
                    continue
                cut = int(np.argmax(score))
                if score[cut] < 0:
                    cut = -1
                    break
                self.take(docs, rests, cut, open_lengths, open_starts, free, self.window - self.used, False)
            if not free.any():
                return

    def take(self, docs, rests, at, open_lengths, open_starts, free, count, seed) -> None:
        whole = rests[at]
        begin = len(whole) - int(open_lengths[at])
        self.piece(docs[at], open_starts[at], whole[begin : begin + count], seed)
        open_lengths[at] -= count
        open_starts[at] += count
        free[at] = open_lengths[at] > 0


def _pack(weights, window: int, block_ids: int, with_ids: bool):
    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True))
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
        if not with_ids:
            columns[-1] = [None] * len(pieces)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "seed", "ids"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(weights.value, window, TaskContext.get().partitionId() << 32)
        alone = Shard(weights.value, window, (TaskContext.get().partitionId() << 32) + (1 << 31))
        docs, rests, starts, held = [], [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype="<u2")
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    alone.piece((doc_id, len(ids)), start, ids[start : start + window], True)
                if len(ids) > whole:
                    docs.append((doc_id, len(ids)))
                    rests.append(ids[whole:])
                    starts.append(whole)
                    held += len(ids) - whole
                if held >= block_ids:
                    shard.block(docs, rests, starts)
                    docs, rests, starts, held = [], [], [], 0
            for side in (alone, shard):
                if side.pieces:
                    yield batch_of(side.pieces)
                    side.pieces = []
        if docs:
            shard.block(docs, rests, starts)
        if shard.pieces:
            yield batch_of(shard.pieces)

    return pack


def shard_count(total: int) -> int:
    return max(1, min(MANY, -(-total // SHARD_IDS)), -(-total // LARGE_SHARD_IDS))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    window: int = WINDOW,
    end: int = END,
    block_ids: int = BLOCK_IDS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    seed, ids)``; ``ids`` are 16-bit (null without ``with_ids``), ``seed`` marks pieces that asked
    for neighbours."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = tokens.with_ids(texts, "text", vocabulary or tokens.default_vocabulary(), end)
    stored = common.put(encoded, "ids")
    # No more rows than ids of a vocabulary come to the driver.
    counts = (
        stored.select("ids").mapInArrow(_document_frequencies(window), "term int, n bigint")
        .groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    )
    found = Weights(counts["term"].to_numpy(), counts["n"].to_numpy())
    weights = spark.sparkContext.broadcast(found)
    # Written, as dealing by ranges reads its input twice.
    signed = common.put(
        stored.mapInArrow(_signatures(weights, window), "doc_id bigint, ids binary, first int, second int"), "signed"
    )
    common.drop(stored)
    order = ["first", "second", F.xxhash64("doc_id", F.length("ids"), F.crc32("ids"))]
    dealt = signed.repartitionByRange(shard_count(found.total), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(_pack(weights, window, block_ids, with_ids), PIECE)
