"""Katz backoff language model over words.

Words and text ends are counted (order 1), then words after words (order 2) and after pairs
(order 3, if asked for); a text begins after ends.  Counts up to five are discounted by
Good-Turing; what the discounts free, and one more event for what was never seen, is the mass
of the lower order:

    p(w | h v) = d(c) c(h v, w) / (c(h v) + 1)           if h v w was seen in training,
               = a(h v) p(w | v)                         else
    p(w)       = d(c) c(w) / (N + 1)                     if w was seen,
               = the mass left over, for the one unknown word, else

where a(h) is what p(. | h) leaves over, divided by the lower order's p of the words never seen
after h.  Every order sums to 1 exactly over the V words and the unknown one.

``fit`` stores tables of counts in partitions, and ``score`` joins any texts with them.  Pairs
and triples are summed by the packet where they are read, then by the shard of the last word of
their context: a shard holds the pairs (v, w) and all triples (u, v, w) over them, so scoring
goes from the triple to the pair without another shuffle.  The count of the last word comes
along: frequent words (a table of at most ``FREQUENT`` entries is broadcast) have it at once,
others pass through the shard of that word in the table of words first.  Texts to score go to
the shards of their contexts at once: a word that is not frequent has its count from the pair it
is in, else from a join with the table of words at the end.  Contexts that end in a
word with more than one part in ``HOT`` of the tokens are dealt out by the word that follows;
what their shards know about them is summed into a table, which the documents' occurrences in
such contexts, counted by document and context, are joined with at the end.  Pairs and triples
are told by hashes of 64 bits within their shard, contexts by hashes of 64 bits.

Sums per document leave a task whenever it holds ``HELD_DOCS`` of them, shards are worked on in
``SUBS`` parts, so memory is bounded whatever the input.

Defined cases: null texts are empty (one end); rows that agree in id and text are one entry,
given back for each; a null id counts as held out; without training texts every word is
unknown; an empty table gives an empty table; columns other than id and text are not read.
Where counts are too few for Good-Turing (a discount outside 0..1) counts are discounted by 1/2.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.components import attach
from gridloom.llm.words import hash_words, mixed

LAST_DISCOUNTED = 5
FREQUENT = 1 << 17
HOT, HOT_LEAST = 500, 50_000
SUBS = 12
SHARDS, SHARD_TOKENS = 24, 6 << 20
#: Texts of a packet; Arrow batches may end it sooner.
PACKET_TEXTS = 5000
HELD_DOCS = 400_000
#: Occurrences of rare words that go on at once.
HELD_PAIRS = 1 << 20
END = np.uint64(xxhash.xxh64_intdigest(b" end "))
#: Order of the model of the query.
ORDER = 3


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, bytes of one rank together, compressed."""
    told = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(told))


def _unpack(blob: bytes) -> list[np.ndarray]:
    told = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))  # noqa: S301 - our own shuffle
    out = []
    for kind, raw in told:
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T.copy().view(kind).ravel())
    return out


def _spread(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts


def _slices(batches: Iterator[pa.RecordBatch], only_training: bool = False):
    """Tokens of many texts at once: (words, words before, words before those, place of the text, keys)."""
    for batch in batches:
        if only_training:
            batch = batch.filter(pc.invert(batch.column("held_out")))
        for begin in range(0, len(batch), PACKET_TEXTS):
            part = batch.slice(begin, PACKET_TEXTS)
            found, counts, _ = hash_words(part.column("text"))
            # Every text's words, then its end.
            flat = np.insert(found, np.cumsum(counts), END)
            before = np.concatenate([[END], flat[:-1]])  # what stands before a text is another's end
            earlier = np.concatenate([[END], before[:-1]])
            earlier[np.cumsum(counts + 1) - (counts + 1)] = END  # not the last word of the text before
            doc = np.repeat(np.arange(len(part)), counts + 1)
            yield flat, before, earlier, doc, part.column("key").to_numpy()


def _word_packets(shards: int):
    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, *_ in _slices(batches, only_training=True):
            word, n = np.unique(flat, return_counts=True)
            to = _spread(word, shards)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(shards + 1))
            each = [order[cuts[k] : cuts[k + 1]] for k in range(shards)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(shards), pa.int32()), pa.array([_pack(word[e], n[e].astype(np.uint32)) for e in each])], names=["shard", "blob"]
            )

    return packets


def _add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of words: one row per shard and sum, words in order."""
    sums: dict[int, list] = {}

    def merged(parts):
        word, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return word, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = sums.setdefault(shard, [])
            parts.append(tuple(_unpack(blob)))
            if len(parts) >= 16:
                sums[shard] = [merged(parts)]
    for shard, parts in sums.items():
        word, n = merged(parts)
        bits = np.frexp(n.astype(float))[1] if len(n) else n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()), pa.array([_pack(word, n)]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                pa.array([np.bincount(n[n <= LAST_DISCOUNTED + 1], minlength=LAST_DISCOUNTED + 2).tolist()], pa.list_(pa.int64())),
                pa.array([np.bincount(bits, minlength=64).tolist()], pa.list_(pa.int64())),
            ],
            names=["shard", "words", "types", "tokens", "sizes", "bits"],
        )


def discounts(sizes: np.ndarray) -> np.ndarray:
    """Katz's discounts of counts 1..5 (place 0 is not used) from the counts of counts 1..6."""
    k = LAST_DISCOUNTED
    r = np.arange(1, k + 1)
    out = np.ones(k + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        over = (k + 1) * sizes[k + 1] / sizes[1]
        d = ((r + 1) * sizes[2 : k + 2] / (r * sizes[1 : k + 1]) - over) / (1 - over)
    out[1:] = d if np.all(np.isfinite(d) & (d > 0) & (d < 1)) else (r - 0.5) / r
    return out


class Words:
    """What order 1 needs of a word's count."""

    def __init__(self, types: int, tokens: int, sizes: np.ndarray):
        self.types, self.tokens = types, tokens
        self.d = discounts(sizes)
        r = np.arange(1, LAST_DISCOUNTED + 1)
        self.unknown = (1 + np.sum((1 - self.d[1:]) * r * sizes[1 : LAST_DISCOUNTED + 1])) / (tokens + 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        low = np.minimum(count, LAST_DISCOUNTED + 1)
        d = np.append(self.d, 1.0)[low]
        return np.where(count > 0, d * count / (self.tokens + 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


class Frequent:
    """Counts of the frequent words, in the order of their hashes, and which contexts are hot."""

    def __init__(self, word: np.ndarray, n: np.ndarray, tokens: int):
        order = np.argsort(word)
        self.word, self.n = word[order], n[order]
        #: Places in the order of the counts: small numbers for what comes often.
        self.by_rank = np.argsort(-self.n, kind="stable")
        self.rank = np.argsort(self.by_rank)
        self.hot = self.word[self.n > max(tokens / HOT, HOT_LEAST)]

    def find(self, word: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if it is not frequent."""
        at = np.searchsorted(self.word, word)
        at[at == len(self.word)] = 0
        return np.where(self.word[at] == word, at, -1) if len(self.word) else np.full(len(word), -1)

    def is_hot(self, word: np.ndarray) -> np.ndarray:
        return np.isin(word, self.hot)


def _gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context and the word after it."""
    return mixed((context * np.uint64(0xC2B2AE3D27D4EB4F)) ^ word)


def _find(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each, -1 if it is not there."""
    if not len(ordered):
        return np.full(len(wanted), -1)
    at = np.searchsorted(ordered, wanted)
    at[at == len(ordered)] = 0
    return np.where(ordered[at] == wanted, at, -1)


def _shard_of(context, word, frequent: Frequent, parts: int) -> np.ndarray:
    return _spread(np.where(frequent.is_hot(context), _gram(context, word), context), parts)


def _handles(part: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Numbers that stand for the texts of a slice, named by a hash of its keys."""
    return mixed(part ^ mixed(docs.astype(np.uint64))).view(np.int64)


def _steps(ordered: np.ndarray) -> np.ndarray:
    """Ascending places as the steps between them, which are small."""
    return np.diff(ordered, prepend=0).astype(np.uint32)


def _named(frequent: Frequent, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the frequent words, from 1, by their counts; 0 for the others, which follow."""
    at = frequent.find(word)
    place = np.zeros(len(word), dtype=np.uint32)
    place[at >= 0] = frequent.rank[at[at >= 0]] + 1
    return place, word[at < 0]


def _unnamed(frequent: Frequent, place: np.ndarray, others: np.ndarray) -> np.ndarray:
    word = np.empty(len(place), dtype=np.uint64)
    word[place == 0] = others
    word[place > 0] = frequent.word[frequent.by_rank[place[place > 0].astype(np.int64) - 1]]
    return word


def _runs(ordered: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal contexts in turn as runs; ``at`` has their places among the frequent words or -1."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, dtype=np.int64)
    run, own = np.diff(np.append(first, len(ordered))), at[first]
    return _steps(own[own >= 0]), np.packbits(own >= 0), ordered[first][own < 0], run.astype(np.uint32)


def _unrun(frequent: Frequent, steps, known, others, run) -> np.ndarray:
    known = np.unpackbits(known, count=len(run)).astype(bool)
    v = np.empty(len(run), dtype=np.uint64)
    v[known], v[~known] = frequent.word[np.cumsum(steps.astype(np.int64))], others
    return np.repeat(v, run)


def _emit(frequent: Frequent, shard, context, word, count, earlier, times, doc, part) -> pa.RecordBatch:
    """One packet for each shard that has occurrences, ordered by context."""
    order = np.argsort(context)
    order = order[np.argsort(shard[order].astype(np.int16 if shard.max() < 1 << 15 else np.int64), kind="stable")]
    shard = shard[order]
    starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    where, _ = _named(frequent, earlier)
    rare = count >= 0
    place = np.zeros(len(count), dtype=np.uint32)  # place among the frequent words, from 1
    place[~rare] = frequent.rank[-count[~rare] - 1] + 1
    context_at = frequent.find(context[order])
    blobs = []
    for begin, end in zip(starts, np.append(starts[1:], len(shard)), strict=True):
        own = order[begin:end]
        docs, at = np.unique(doc[own], return_inverse=True)
        odd = own[rare[own]]
        blobs.append(
            _pack(*_runs(context[own], context_at[begin:end]), place[own], word[odd],
                  count[odd].astype(np.uint32), where[own], earlier[own][where[own] == 0], times[own].astype(np.uint32),
                  at.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32), _steps(docs), np.array([part], dtype=np.uint64))
        )
    return pa.RecordBatch.from_arrays([pa.array(shard[starts], pa.int32()), pa.array(blobs)], names=["shard", "blob"])


def _read(blob: bytes, frequent: Frequent) -> tuple:
    """(context, word, count, earlier word, times, place of the document, keys) of a packet; the
    count of a word that is not frequent may be 0, for one not known yet."""
    steps, known, rare_v, run, place, rare_word, rare_count, where, rare_earlier, times, at, docs, part = _unpack(blob)
    word, count = np.empty(len(place), dtype=np.uint64), np.empty(len(place), dtype=np.int64)
    rare = place == 0
    word[rare], count[rare] = rare_word, rare_count
    told = frequent.by_rank[place[~rare].astype(np.int64) - 1]
    word[~rare], count[~rare] = frequent.word[told], frequent.n[told]
    earlier = _unnamed(frequent, where, rare_earlier)
    keys = _handles(part, np.cumsum(docs.astype(np.int64)))
    return _unrun(frequent, steps, known, rare_v, run), word, count, earlier, times.astype(np.int64), at.astype(np.int64), keys


def _joined(packets: list[tuple]) -> tuple:
    """Packets as one, documents one after another."""
    context, word, count, earlier, times, doc, keys = (np.concatenate(c) for c in zip(*packets, strict=True))
    shift = np.cumsum([0] + [len(p[6]) for p in packets[:-1]])
    return context, word, count, earlier, times, doc + np.repeat(shift, [len(p[0]) for p in packets]), keys


def _types(table, parts: int, order: int, rare: bool):
    """Training types, with their counts, whose last word is frequent, or is not."""

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = table.value
        for flat, before, earlier, *_ in _slices(batches, only_training=True):
            at = frequent.find(flat)
            own = np.flatnonzero(at < 0 if rare else at >= 0)
            if not len(own):
                continue
            flat, before, at = flat[own], before[own], at[own]
            earlier = earlier[own] if order == 3 else np.zeros(len(own), dtype=np.uint64)
            _, first, times = np.unique(_gram(_gram(earlier, before), flat), return_index=True, return_counts=True)
            flat, before, earlier, at = flat[first], before[first], earlier[first], at[first]
            none = np.zeros(len(first), dtype=np.int64)
            if rare:
                # Ordered by the word itself here: it takes the place of the context.
                yield _emit(frequent, _spread(flat, parts), flat, before, none, earlier, times, none, 0)
            else:
                yield _emit(frequent, _shard_of(before, flat, frequent, parts), before, flat, -(at + 1), earlier, times, none, 0)

    return packets


def _tokens(table, parts: int, order: int):
    """All tokens of texts for the shards of their contexts; for each slice of texts one packet more,
    of a shard below 0, says which keys its texts have."""

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = table.value
        for flat, before, earlier, doc, keys in _slices(batches):
            if order == 2:
                earlier = np.zeros(len(flat), dtype=np.uint64)
            at = frequent.find(flat)
            name = xxhash.xxh64_intdigest(keys.tobytes())
            count, once = np.where(at >= 0, -(at + 1), 0), np.ones(len(flat), dtype=np.int64)
            yield _emit(frequent, _shard_of(before, flat, frequent, parts), before, flat, count, earlier, once, doc, name)
            told = _pack(np.array([name], dtype=np.uint64), keys)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - name % parts], pa.int32()), pa.array([told])], names=["shard", "blob"])

    return packets


def _count_rare(table, parts: int):
    """Occurrences of rare words meet the table of words and go on to their contexts with a count."""

    def attach_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, words = table.value, {}
        held: list[tuple] = []

        def onward() -> Iterator[pa.RecordBatch]:
            context, word, count, earlier, times = (np.concatenate(c) for c in zip(*held, strict=True))
            none = np.zeros(len(context), dtype=np.int64)
            yield _emit(frequent, _shard_of(context, word, frequent, parts), context, word, count, earlier, times, none, 0)

        size = 0
        for batch in batches:
            for shard, blob, is_table in zip(*(batch.column(c).to_pylist() for c in ("shard", "blob", "is_table")), strict=True):
                if is_table:
                    words = {shard: _unpack(blob)}
                    continue
                known, n = words.get(shard, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
                word, context, _, earlier, times, *_ = _read(blob, frequent)
                place = _find(known, word)
                count = np.where(place >= 0, n[place], 0) if len(known) else np.zeros(len(word), dtype=np.int64)
                held.append((context, word, count, earlier, times))
                size += len(context)
                if size >= HELD_PAIRS // 2:
                    yield from onward()
                    held, size = [], 0
        if size:
            yield from onward()

    return attach_counts


def _sum_grams(table, order: int):
    """The tables of pairs and triples: one row per shard."""

    def summed(packets: list[tuple]) -> tuple:
        context, word, count, earlier, times, *_ = (np.concatenate(c) for c in zip(*packets, strict=True))
        _, first, at = np.unique(_gram(_gram(earlier, context), word), return_index=True, return_inverse=True)
        n = np.bincount(at, weights=times).astype(np.int64)
        return context[first], word[first], count[first], earlier[first], n

    def row(shard: int, packets: list[tuple]) -> pa.RecordBatch:
        frequent = table.value
        context, word, count, earlier, n3 = summed(packets)
        _, first, pair = np.unique(_gram(context, word), return_index=True, return_inverse=True)
        # Pairs in the order of their contexts.
        order2 = np.argsort(context[first], kind="stable")
        first, pair = first[order2], np.argsort(order2)[pair]
        n2 = np.bincount(pair, weights=n3).astype(np.int64)
        by = np.argsort(pair, kind="stable")
        triples = (np.bincount(pair).astype(np.uint32), *_named(frequent, earlier[by]), n3[by].astype(np.uint32)) if order == 3 else ()
        place, others = _named(frequent, word[first])
        pairs = (*_runs(context[first], frequent.find(context[first])), place, others, count[first][place == 0].astype(np.uint32))
        blob = _pack(*pairs, n2.astype(np.uint32), *triples)
        sizes = [np.bincount(n[n <= LAST_DISCOUNTED + 1], minlength=LAST_DISCOUNTED + 2).tolist() for n in (n2, n3)]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), *[pa.array([x], pa.list_(pa.int64())) for x in sizes]],
            names=["shard", "blob", "sizes2", "sizes3"],
        )

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, part, packets, size, last = table.value, None, [], 0, 0
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if shard != part and packets:
                    yield row(part, packets)
                    packets, size, last = [], 0, 0
                part = shard
                packets.append(_read(blob, frequent)[:5])
                size += len(packets[-1][0])
                if size >= HELD_PAIRS + 2 * last:
                    packets = [summed(packets)]
                    size = last = len(packets[0][0])
        if packets:
            yield row(part, packets)

    return grams


class Part:
    """What one part of the stored tables says of its pairs, triples and contexts."""

    def __init__(self, blob: bytes | None, frequent: Frequent, words: Words, d: list[np.ndarray]):
        empty = [np.zeros(0, dtype=t) for t in ("u4", "u1", "u8", "u4", "u4", "u8", "u4", "u4", "u4", "u4", "u8", "u4")]
        steps, known, others, run, place, rare, rare_n1, n2, *triples = _unpack(blob) if blob is not None else empty
        v, w, n2 = _unrun(frequent, steps, known, others, run), _unnamed(frequent, place, rare), n2.astype(np.int64)
        n1 = np.empty(len(w), dtype=np.int64)
        n1[place == 0], n1[place > 0] = rare_n1, frequent.n[frequent.by_rank[place[place > 0].astype(np.int64) - 1]]
        kept, self.contexts = d[0][np.minimum(n2, LAST_DISCOUNTED + 1)] * n2, []
        own, at = np.unique(v, return_inverse=True)
        hot = frequent.is_hot(own)
        total = np.bincount(at, weights=n2, minlength=len(own))
        whole = total.copy()
        whole[hot] = frequent.n[frequent.find(own[hot])]
        p = kept / (whole[at] + 1)
        self.contexts.append(self._context(own, hot, at, total, kept, words.p(n1)))
        pairs = _gram(v, w)
        order = np.argsort(pairs)
        self.pairs, self.log2, self.n1 = pairs[order], np.log10(p)[order], n1[order]
        if not triples:
            return
        runs, earlier, rare_earlier, n3 = triples
        u = _unnamed(frequent, earlier, rare_earlier)
        pair, n3 = np.repeat(np.arange(len(v)), runs), n3.astype(np.int64)
        kept = d[1][np.minimum(n3, LAST_DISCOUNTED + 1)] * n3
        context = _gram(u, v[pair])
        own, first, at = np.unique(context, return_index=True, return_inverse=True)
        hot = frequent.is_hot(v[pair][first])
        total = np.bincount(at, weights=n3, minlength=len(own))
        self.contexts.append(self._context(own, hot, at, total, kept, p[pair]))
        # In contexts that are spread, the total comes later.
        self.triples, self.log3 = self._ordered(_gram(context, w[pair]), np.log10(kept) - np.where(hot, 0, np.log10(total + 1))[at])

    @staticmethod
    def _ordered(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        return key[order], value[order]

    @staticmethod
    def _context(own, hot, at, total, kept, lower) -> dict[str, np.ndarray]:
        held, mass = (np.bincount(at, weights=x, minlength=len(own)) for x in (kept, lower))
        back = np.zeros(len(own))
        done = ~hot
        back[done] = np.log10((1 - held[done] / (total[done] + 1)) / (1 - mass[done]))
        return {"key": own, "hot": hot, "total": total, "held": held, "mass": mass, "back": back}

    def back(self, order: int, context: np.ndarray) -> np.ndarray:
        """Logarithms of a(context); 0 for contexts never seen."""
        table = self.contexts[order - 2]
        at = _find(table["key"], context)
        return np.where(at >= 0, table["back"][at], 0.0) if len(table["key"]) else np.zeros(len(context))


def _spread_contexts(table, model):
    """What each shard knows of contexts that are dealt out."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                for context in Part(blob, table.value, *model.value).contexts:
                    own = context["hot"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(context["key"][own].view(np.int64)), *[pa.array(context[c][own].astype(float)) for c in ("total", "held", "mass")]],
                        names=["context", "total", "held", "mass"],
                    )

    return sums


FOUND = "key bigint, owner bigint, context bigint, word bigint, n double, known double, base double, score double, hits double, misses double"
SUMMED = ("n", "known", "base", "score")


def _rows(length: int, **columns) -> pa.RecordBatch:
    """Rows of documents, or of documents and spread contexts or words without a count; a document's
    own row has neither.  ``key`` is a handle; one row at least has the key of the document as its owner."""
    filled = []
    for field in (f.split()[0] for f in FOUND.split(", ")):
        if field in ("key", "owner", "context", "word"):
            filled.append(pa.array(columns[field]) if field in columns else pa.nulls(length, pa.int64()))
        else:
            filled.append(pa.array(np.asarray(columns.get(field, np.zeros(length)), dtype=np.float64)))
    return pa.RecordBatch.from_arrays(filled, names=[f.split()[0] for f in FOUND.split(", ")])


def _added(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sums of two tables of documents, by key."""
    both = np.concatenate([one, two])
    key, at = np.unique(both["key"], return_inverse=True)
    out = np.zeros(len(key), dtype=both.dtype)
    out["key"] = key
    for field in both.dtype.names[1:]:
        out[field] = np.bincount(at, weights=both[field])
    return out


def _score(table, model, order: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, (words, d) = table.value, model.value
        sums: np.ndarray | None = None
        shard_now, part, packets, size = None, None, [], 0

        def docs_out():
            if sums is not None:
                yield _rows(len(sums), **{f: sums[f] for f in sums.dtype.names})

        def work():
            nonlocal sums
            v, w, count, u, _, doc, keys = _joined(packets)
            hot = frequent.is_hot(v)
            pair = _find(part.pairs, _gram(v, w))
            if len(part.pairs):
                count = np.where((count == 0) & (pair >= 0), part.n1[pair], count)
            # What is neither frequent nor in a pair gets its count, and p of it, at the end.
            late = count == 0
            log = np.where(late, 0.0, np.log10(words.p(count))) + part.back(2, v)
            if len(part.pairs):
                log = np.where(pair >= 0, part.log2[pair], log)
            seen = {"context": [v[hot & (pair < 0)]], "doc": [doc[hot & (pair < 0)]], "hit": []}
            if order == 3:
                context = _gram(u, v)
                triple = _find(part.triples, _gram(context, w)) if len(part.pairs) else np.full(len(v), -1)
                hit = triple >= 0
                log = log + part.back(3, context)
                if len(part.pairs):
                    log = np.where(hit, part.log3[triple], log)
                seen["context"].append(context[hot])
                seen["doc"].append(doc[hot])
                seen["hit"] = [np.zeros(len(seen["doc"][0]), dtype=bool), hit[hot]]
            docs, at = np.unique(keys[doc], return_inverse=True)
            out = np.zeros(len(docs), dtype=[("key", "i8"), *[(f, "f8") for f in SUMMED]])
            out["key"] = docs
            base = np.where(late, 0.0, words.base(count))
            for field, each in zip(SUMMED, (None, count > 0, base, log), strict=True):
                out[field] = np.bincount(at, weights=each, minlength=len(docs))
            sums = out if sums is None else _added(sums, out)
            if late.any():
                word, c = np.unique(w[late], return_inverse=True)
                own, times = np.unique(at[late] << 32 | c, return_counts=True)
                yield _rows(len(own), key=docs[own >> 32], word=word[own & 0xFFFFFFFF].view(np.int64), misses=times)
            context, of = np.concatenate(seen["context"]), keys[np.concatenate(seen["doc"])]
            hits = np.concatenate(seen["hit"]) if seen["hit"] else np.zeros(len(context), dtype=bool)
            if len(context):
                # One row for each document and context.
                contexts, c = np.unique(context, return_inverse=True)
                own, k = np.unique(np.searchsorted(docs, of) << 32 | c, return_inverse=True)
                yield _rows(len(own), key=docs[own >> 32], context=contexts[own & 0xFFFFFFFF].view(np.int64),
                            hits=np.bincount(k, weights=hits), misses=np.bincount(k, weights=~hits))

        for batch in batches:
            for shard, blob, is_table in zip(*(batch.column(c).to_pylist() for c in ("shard", "blob", "is_table")), strict=True):
                if shard < 0:
                    name, keys = _unpack(blob)
                    yield _rows(len(keys), key=_handles(name, np.arange(len(keys))), owner=keys)
                    continue
                if packets and (shard != shard_now or size >= HELD_PAIRS // 4):
                    yield from work()
                    packets, size = [], 0
                if shard != shard_now:
                    shard_now, part = shard, Part(blob if is_table else None, frequent, words, d)
                if not is_table:
                    packets.append(_read(blob, frequent))
                    size += len(packets[-1][0])
                if sums is not None and len(sums) >= HELD_DOCS:
                    yield from docs_out()
                    sums = None
        if packets:
            yield from work()
        yield from docs_out()

    return score


PACKET = "shard int, blob binary"


@dataclass
class Model:
    """A fitted model: ``words``, ``grams`` and ``spread`` are stored tables, the rest is small."""

    order: int
    shards: int
    tokens: int
    words: DataFrame
    grams: DataFrame
    spread: DataFrame
    frequent: object
    small: object


def _out_fold(id_col: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0)) == 0


def _texts(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    key = F.xxhash64(id_col, common.text_or_empty(text_col))
    return docs.select(key.alias("key"), F.col(text_col).cast("binary").alias("text"), _out_fold(id_col, folds).alias("held_out"))


def _types_by_context(texts: DataFrame, vocabulary: DataFrame, table, shards: int, order: int) -> DataFrame:
    """Packets of training types, with the counts of their last words, for the shards of their contexts."""
    parts = shards * SUBS
    rare = texts.mapInArrow(_types(table, parts, order, True), PACKET).withColumn("is_table", F.lit(False))
    entries = vocabulary.select("shard", F.col("words").alias("blob"), F.lit(True).alias("is_table"))
    met = rare.unionByName(entries).repartition(shards, "shard").sortWithinPartitions("shard", F.desc("is_table"))
    often = texts.mapInArrow(_types(table, parts, order, False), PACKET)
    return often.unionByName(met.mapInArrow(_count_rare(table, parts), PACKET))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = ORDER) -> Model:
    """Learn from the rows whose crc32 of the id, as text, is not divisible by ``folds``."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is neither 2 nor 3")
    spark = docs.sparkSession
    common.ship(spark)
    texts = _texts(docs, id_col, text_col, folds)
    size = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars")).first()["chars"]
    shards = max(SHARDS, -(-size // 6 // SHARD_TOKENS))
    packets = texts.mapInArrow(_word_packets(shards * SUBS), PACKET).repartition(shards, "shard")
    vocabulary = common.put(
        packets.mapInArrow(_add_words, "shard int, words binary, types bigint, tokens bigint, sizes array<bigint>, bits array<bigint>"), "words"
    )
    told = vocabulary.select("types", "tokens", "sizes", "bits").collect()  # a few numbers for each shard
    types, tokens = (sum(r[k] for r in told) for k in (0, 1))
    sizes = np.sum([r.sizes for r in told], axis=0) if told else np.zeros(LAST_DISCOUNTED + 2)
    bits = np.sum([r.bits for r in told], axis=0) if told else np.zeros(64)
    above = np.cumsum(bits[::-1])[::-1]
    least = int(np.flatnonzero(above <= FREQUENT)[0]) if (above > FREQUENT).any() else 0
    frequent = _frequent_words(vocabulary, 1 << max(least - 1, 0), tokens)
    table = spark.sparkContext.broadcast(frequent)

    dealt = _types_by_context(texts, vocabulary, table, shards, order).repartition(shards, "shard").sortWithinPartitions("shard")
    grams = common.put(dealt.mapInArrow(_sum_grams(table, order), PACKET + ", sizes2 array<bigint>, sizes3 array<bigint>"), "grams")
    columns = [F.sum(F.get(f"sizes{k}", F.lit(r))) for k in (2, 3) for r in range(LAST_DISCOUNTED + 2)]
    found = np.array([x or 0 for x in grams.agg(*columns).first()], dtype=float).reshape(2, -1)
    small = spark.sparkContext.broadcast((Words(types, tokens, sizes), [np.append(discounts(f), 1.0) for f in found]))
    known = grams.select("blob").mapInArrow(_spread_contexts(table, small), "context bigint, total double, held double, mass double")
    spread = known.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("total", "held", "mass")]).select(
        "context", F.log10(F.col("total") + 1).alias("below"),
        F.log10((1 - F.col("held") / (F.col("total") + 1)) / (1 - F.col("mass"))).alias("back"),
    )
    return Model(order, shards, tokens, vocabulary, grams, common.put(spread, "spread"), table, small)


def score(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row, be it of the fitted table or not."""
    common.ship(docs.sparkSession)
    texts = _texts(docs, id_col, text_col, folds)
    asked = texts.mapInArrow(_tokens(model.frequent, model.shards * SUBS, model.order), PACKET).withColumn("is_table", F.lit(False))
    dealt = asked.unionByName(model.grams.select("shard", "blob", F.lit(True).alias("is_table"))).repartition(model.shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", F.desc("is_table"))
    found = common.put(dealt.mapInArrow(_score(model.frequent, model.small, model.order), FOUND), "found")
    return _finished(docs, id_col, F.xxhash64(id_col, common.text_or_empty(text_col)), _out_fold(id_col, folds), found, model)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = ORDER) -> DataFrame:
    """Scores of all rows under the model of their training rows."""
    return score(fit(docs, id_col, text_col, folds, order), docs, id_col, text_col, folds)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of words, a row for each."""
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            word, n = _unpack(blob)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n1"])


def _frequent_words(vocabulary: DataFrame, least: int, tokens: int) -> Frequent:
    """The words that occur at least ``least`` times: at most ``FREQUENT`` by the choice of it."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                word, n = _unpack(blob)
                own = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(word[own].view(np.int64)), pa.array(n[own])], names=["word", "n"])

    rows = vocabulary.select("words").mapInArrow(some, "word bigint, n bigint").toArrow()
    return Frequent(rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy(), tokens)


def _finished(docs, id_col, key, out_fold, found: DataFrame, model: Model) -> DataFrame:
    """Put in what is known of spread contexts and of words without a count, and add up each document."""
    own = found.where("context IS NULL AND word IS NULL").select("key", "owner", *SUMMED)
    late = attach(found.where("context IS NOT NULL").select("key", "context", "hits", "misses"), model.spread, "context")
    zero = F.lit(0.0)
    later = F.col("misses") * F.coalesce("back", zero) - F.col("hits") * F.coalesce("below", zero)
    late = late.select("key", *[zero.alias(c) for c in SUMMED[:-1]], later.alias("score"))
    small = model.small.value[0]
    counted = attach(
        found.where("word IS NOT NULL").select("key", "word", F.col("misses").alias("times")),
        model.words.select("words").mapInArrow(_word_counts, "word bigint, n1 bigint"), "word",
    ).withColumn("n1", F.coalesce("n1", F.lit(0)))
    d = F.get(F.array(*[F.lit(float(x)) for x in [*small.d, 1.0]]), F.least("n1", F.lit(LAST_DISCOUNTED + 1)).cast("int"))
    p = F.when(F.col("n1") > 0, d * F.col("n1") / F.lit(small.tokens + 1.0)).otherwise(F.lit(float(small.unknown)))
    base = F.log10((F.col("n1") + 0.1) / F.lit(small.tokens + 0.1 * (small.types + 1)))
    unseen = counted.select(
        "key", zero.alias("n"), F.when(F.col("n1") > 0, F.col("times")).otherwise(zero).alias("known"),
        (F.col("times") * base).alias("base"), (F.col("times") * F.log10(p)).alias("score"),
    )
    more = late.unionByName(unseen).withColumn("owner", F.lit(None).cast("bigint"))
    by_handle = own.unionByName(more).groupBy("key").agg(F.max("owner").alias("owner"), *[F.sum(c).alias(c) for c in SUMMED])
    scored = by_handle.groupBy(F.col("owner").alias("key")).agg(*[F.sum(c).alias(c) for c in SUMMED])
    rows = docs.select(F.col(id_col).alias("doc_id"), out_fold.alias("held_out"), key.alias("key"))
    times = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    each = common.put(scored.join(times, "key"), "scored")
    whole = lambda c: F.round(F.col(c) / F.col("times")).cast("bigint")
    return attach(rows, each, "key", "inner").select(
        "doc_id", "held_out", whole("n").alias("n_tokens"), whole("known").alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("times")).alias("base_score"), (F.col("score") / F.col("times")).alias("score"),
    )
