"""Phrases of words that stand together more often than apart, counted exactly.

A phrase counts only if it occurs ``least`` times in its language.  Which ones do is found by
Misra-Gries summaries: the hash space of phrases is cut into ranges; every task counts the
phrases of its texts and sends each range its counts, and a range merges them into a summary
of more counters than its mass divided by ``least``: when counters run out, the first count
beyond them is taken off all.  What is taken off in all is below ``least``, so every frequent
phrase keeps a counter, however its occurrences are spread.  Ranges have a bounded mass, so a
summary fits its task at every size, and a phrase that a third of all rows hold arrives as one
count per packet.

The survivors become bits of a filter (at most ``MOST_PLACES``; a range of hashes is a range of
bits, so every range folds its own).  A second pass over the texts counts the phrases that pass,
and whose parts pass, by their very words, so hashes that agree or false alarms change nothing.

Every occurrence of a word belongs to its language (null: ``und``).  Letters A-Z are taken as
a-z; ``.,;:!?`` and line ends part a text into pieces that no phrase crosses.  Scores are whole
numbers of up to 38 digits.

Defined cases: a null or empty text has no words; repeated rows count again; a language without
a frequent phrase gives no row; an empty table gives an empty table; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.words import MULTIPLIERS, bytes_of, ends_of, hash_bytes, mixed

LEAST = 10
TOP = 2000
#: A phrase goes when a longer one has at least this percent of its occurrences.
ABSORBED_PERCENT = 50
LONGEST = 3
NO_LANG = "und"

#: Bytes of a range's texts, about: bounds the counts one task merges.
RANGE_BYTES = 1 << 21
MOST_RANGES = 1 << 20
#: Counts a task sends together; it holds up to twice as many.
PACKET = 1 << 19
CHUNK_BYTES = 1 << 20
#: Words whose phrases get whole-number codes together: three codes below 2**21 fit 63 bits.
BLOCK_WORDS = 1 << 20
#: Rows of counted phrases a task holds before it sends them.
HELD_ROWS = 1 << 17
#: Rows and ranges of a batch on its way to Spark: bounds what it keeps outside its heap.
SENT_ROWS, SENT_RANGES = 1 << 15, 16
LEAST_PLACES, MOST_PLACES, PLACES_PER_PHRASE = 1 << 16, 1 << 28, 16
SEGMENTS = 1024
SALTS = 64

_ends = np.zeros(256, dtype=bool)
_ends[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
# What is not part of a word becomes a blank, A-Z becomes a-z.
_plain = np.arange(256, dtype=np.uint8)
_plain[65:91] += 32
_plain[_ends] = 32


class _Words:
    """The words of texts that follow each other: hashes, places, and who is whose neighbour."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lang: np.ndarray, seeds: np.ndarray):
        self.raw = _plain[raw]
        self.offsets = offsets
        self.hashes, counts, self.at = hash_bytes(self.raw, offsets)
        row = np.repeat(np.arange(len(counts)), counts)
        self.lang = lang[row]
        self.seed = seeds[self.lang] if len(row) else np.zeros(0, dtype=np.uint64)
        piece = np.cumsum(_ends[raw], dtype=np.int64)[self.at]
        # Whether a word and the next are neighbours, and a word and the next two.
        self.two = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        self.three = self.two[1:] & self.two[:-1]

    def grams(self) -> list[np.ndarray]:
        """Hashes of the phrases of one, two and three words that begin at each word; those that
        cross a piece are made too and have to be masked."""
        a, b, c, d, e = (np.uint64(m) for m in MULTIPLIERS)
        h, s = self.hashes, self.seed
        one = mixed(h * a + s)
        two = mixed(h[:-1] * b + h[1:] * c + s[:-1] + np.uint64(1))
        three = mixed(h[:-2] * d + h[1:-1] * e + h[2:] * a + s[:-2] + np.uint64(2))
        return [one, two, three[: max(len(h) - 2, 0)]]


def _lang_seeds(names: list[bytes]) -> np.ndarray:
    """A random number for each language."""
    lengths = np.array([len(n) for n in names], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    raw = np.frombuffer(b"".join(names), dtype=np.uint8)
    # A sum over bytes by place and value: nothing in a name is a blank here.
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], lengths)
    value = mixed((raw.astype(np.uint64) + np.uint64(257)) * (place.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIERS[3]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    return mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.uint64(MULTIPLIERS[4]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[bytes]]]:
    """The words of a few texts at a time, with the languages their numbers stand for."""
    for batch in batches:
        coded = batch.column("lang").cast(pa.binary()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seeds = _lang_seeds(names)
        raw, offsets = bytes_of(batch.column("text"))
        begin, rows = 0, len(offsets) - 1
        while begin < rows:
            end = int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, "right")) - 1
            end = min(max(end, begin + 1), rows)
            lo, hi = offsets[begin], offsets[end]
            if hi > lo:
                yield _Words(raw[lo:hi], offsets[begin : end + 1] - lo, lang[begin:end], seeds), names
            begin = end


def merge(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same hash added up, by hash."""
    keys, n = np.concatenate(hashes), np.concatenate(counts)
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters; ``lost`` bounds what any count lacks."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.hashes, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, hashes: list[np.ndarray], counts: list[np.ndarray]) -> None:
        keys, n = merge([self.hashes, *hashes], [self.counts, *counts])
        if len(keys) > self.capacity:
            at = len(n) - self.capacity - 1
            cut = int(np.partition(n, at)[at])
            self.lost += cut
            stay = n > cut
            keys, n = keys[stay], n[stay] - cut
        self.hashes, self.counts = keys, n

    def survivors(self, least: int) -> np.ndarray:
        """Hashes that may stand for ``least`` occurrences."""
        return self.hashes[self.counts + self.lost >= least]


def _count_packets(ranges: int):
    """First pass: counts of phrase hashes, a row for each packet and range."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def packets(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (keys >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(keys), dtype=np.int64)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, dtype=np.int64)
        ends = np.append(first[1:], len(keys))
        n = n.astype(np.uint32)
        for at in range(0, len(first), SENT_RANGES):
            cuts = list(zip(first[at : at + SENT_RANGES], ends[at : at + SENT_RANGES], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[first[at : at + SENT_RANGES]]),
                    pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
                    pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary()),
                ],
                names=["part", "hashes", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = mass = 0
        for words, _ in _chunks(batches):
            one, two, three = words.grams()
            mass += 3 * len(one)
            keys, n = np.unique(np.concatenate([one, two[words.two], three[words.three]]), return_counts=True)
            hashes.append(keys)
            counts.append(n.astype(np.int64))
            held += len(keys)
            if held >= 2 * PACKET or mass >> 31:  # counts are sent as 32 bits
                keys, n = merge(hashes, counts)
                hashes, counts, held = [keys], [n], len(keys)
                if held >= PACKET or mass >> 31:
                    yield from packets(keys, n)
                    hashes, counts, held, mass = [], [], 0, 0
        if hashes:
            yield from packets(*merge(hashes, counts))

    return run


def _survivors(least: int):
    """Merge of a range's packets: the hashes that may be frequent."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        counts = [np.frombuffer(b.as_py(), dtype=np.uint32) for b in table.column("counts")]
        mass = sum(int(n.sum(dtype=np.int64)) for n in counts)
        summary = Summary(2 * (mass // least) + 1024)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for packet, n in zip(table.column("hashes"), counts, strict=True):
            waiting.append((np.frombuffer(packet.as_py(), dtype=np.uint64), n.astype(np.int64)))
            if sum(len(h) for h, _ in waiting) >= summary.capacity:
                summary.add([h for h, _ in waiting], [n for _, n in waiting])
                waiting = []
        if waiting:
            summary.add([h for h, _ in waiting], [n for _, n in waiting])
        left = summary.survivors(least)
        return pa.table({"part": [part], "n": [len(left)], "hashes": pa.array([left.tobytes()], pa.binary())})

    return run


def _segments(places: int, segments: int):
    """Bits of the survivors of a range, in the segment of the filter that is theirs."""
    width = places // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("hashes"):
                hashes = np.frombuffer(blob.as_py(), dtype=np.uint64)
                place = (hashes >> np.uint64(65 - places.bit_length())).astype(np.int64)
                for segment in np.unique(place // width):
                    bits = np.zeros(width, dtype=bool)
                    bits[place[place // width == segment] % width] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([segment]), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["segment", "bits"]
                    )

    return run


def _fold(table: pa.Table) -> pa.Table:
    """One segment from the bits of all its ranges."""
    bits = None
    for blob in table.column("bits"):
        more = np.frombuffer(blob.as_py(), dtype=np.uint8)
        bits = more if bits is None else bits | more
    return pa.table({"segment": [table.column("segment")[0].as_py()], "bits": pa.array([bits.tobytes()], pa.binary())})


def frequent_filter(docs: DataFrame, least: int = LEAST) -> np.ndarray:
    """Bits of the hashes of all phrases that may occur ``least`` times; ``docs`` has lang and text."""
    octets = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    ranges = 1
    while ranges < MOST_RANGES and ranges * RANGE_BYTES < octets:
        ranges *= 2
    packets = docs.mapInArrow(_count_packets(ranges), "part bigint, hashes binary, counts binary")
    left = common.put(
        packets.groupBy("part").applyInArrow(_survivors(least), "part bigint, n bigint, hashes binary"), "survivors"
    )
    count = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = min(MOST_PLACES, max(LEAST_PLACES, 1 << (PLACES_PER_PHRASE * max(count, 1) - 1).bit_length()))
    segments = min(ranges, SEGMENTS)
    bits = np.zeros((segments, places // segments // 8), dtype=np.uint8)
    folded = left.mapInArrow(_segments(places, segments), "segment bigint, bits binary")
    if ranges > segments:
        folded = folded.groupBy("segment").applyInArrow(_fold, "segment bigint, bits binary")
    for row in folded.toLocalIterator():  # together no more than the filter
        bits[row.segment] |= np.frombuffer(row.bits, dtype=np.uint8)
    common.drop(left)
    return bits.ravel()


def _hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(65 - (len(bits) * 8).bit_length())).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _word_strings(words: _Words, begin: int, end: int) -> pa.Array:
    """The words from ``begin`` to ``end`` as a dictionary array."""
    first = words.at[begin:end]
    size = ends_of(words.raw, first, words.offsets) - first
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    raw = words.raw[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()


_COUNTED = pa.schema([("lang", pa.binary()), ("phrase", pa.binary()), ("n", pa.int64())])


def _exact(words: _Words, names: list[bytes], bits: np.ndarray) -> Iterator[pa.Table]:
    """Phrases that pass the filter with their counts, and all words of a language under no phrase."""
    one, two, three = words.grams()
    pass_one = _hit(bits, one)
    pass_two = words.two & _hit(bits, two) & pass_one[1:] & pass_one[:-1]
    pass_three = words.three & _hit(bits, three) & pass_two[1:] & pass_two[:-1]
    langs = pa.array(names, pa.binary())
    total = np.bincount(words.lang, minlength=len(names))
    yield pa.table([langs, pa.array([b""] * len(names), pa.binary()), pa.array(total)], schema=_COUNTED)
    for begin in range(0, len(one), BLOCK_WORDS):
        end = min(begin + BLOCK_WORDS, len(one))
        coded = _word_strings(words, begin, min(end + LONGEST - 1, len(one)))
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size, texts = len(coded.dictionary), coded.dictionary
        # A phrase is of the language of its first word.
        pairs, lead = np.unique(words.lang[begin:end] * size + ids[: end - begin], return_inverse=True)
        for k, passed in enumerate((pass_one, pass_two, pass_three), 1):
            at = np.flatnonzero(passed[begin:end])
            code = lead[at]
            for j in range(1, k):
                code = code | (ids[at + j] << 21 * j)
            code, where, n = np.unique(code, return_index=True, return_counts=True)
            where = at[where]
            parts = [texts.take(pa.array(ids[where + j])) for j in range(k)]
            phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
            lang = langs.take(pa.array(pairs[lead[where]] // size))
            yield pa.table([lang, phrase, pa.array(n)], schema=_COUNTED)


def _count_exactly(shared):
    """Second pass: ``(lang, phrase, n)`` of the texts of a task, added up as far as is held."""
    out = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def summed(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        return table.rename_columns({"n_sum": "n"}).select(["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held: list[pa.Table] = []
        rows = 0
        for words, names in _chunks(batches):
            for table in _exact(words, names, bits):
                held.append(table)
                rows += len(table)
            if rows >= 2 * HELD_ROWS:
                held = [summed(held)]
                rows = len(held[0])
                if rows >= HELD_ROWS:
                    yield from held[0].cast(out).to_batches(max_chunksize=SENT_ROWS)
                    held, rows = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield from summed(held).cast(out).to_batches(max_chunksize=SENT_ROWS)

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, phrase, a)``: exact counts of all phrases of one to three words that occur at least
    ``least`` times, and of all words of a language under the empty phrase."""
    spark = docs.sparkSession
    common.ship(spark)
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`"), F.lit(NO_LANG)).alias("lang"),
        common.text_or_empty(F.col(f"`{text_col}`")).alias("text"),
    )
    shared = spark.sparkContext.broadcast(frequent_filter(texts, least))
    counted = texts.mapInArrow(_count_exactly(shared), "lang string, phrase string, n bigint")
    sums = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where((F.col("a") >= least) | (F.col("phrase") == ""))
    table = common.put(sums.where("a > 0"), "phrases")
    shared.destroy()
    return table


def _key(lang: str, phrase: Column) -> Column:
    """Words hold no tab, so language and phrase can be told apart again."""
    return F.concat(F.col(lang), F.lit("\t"), phrase)


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, absorbed_percent: int = ABSORBED_PERCENT,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two and three words."""
    counts = phrase_counts(docs, least, lang_col, text_col)
    totals = counts.where("phrase = ''").select("lang", F.col("a").alias("n"))
    grams = counts.where("phrase <> ''")
    words = F.split("phrase", " ")
    found = grams.select("lang", "phrase", "a", words.alias("w")).where("size(w) > 1")
    # Every cut of every candidate, with the counts of both its parts.
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = found.select(
        "lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut")
    ).select(
        "lang", "phrase", "a", "cut", F.xxhash64("phrase").alias("spread"),
        _key("lang", part(F.lit(1), F.col("cut"))).alias("left"),
        _key("lang", part(F.col("cut") + 1, F.size("w"))).alias("right"),
    )
    table = grams.select(_key("lang", F.col("phrase")).alias("key"), F.col("a").alias("f"))
    met = cuts
    for side, name in (("left", "l"), ("right", "r")):
        met = common.lookup(met, table.select(F.col("key").alias(side), F.col("f").alias(name)), side, name)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    square = (F.lit(10**6).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)"))
    scored = met.withColumn("top", square).withColumn("base", (wide("l") * wide("r")).cast("decimal(38,0)"))
    score = F.struct(F.expr("top div base").alias("score"), "cut", "l", "r")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(score).alias("b"))
    # The most frequent longer candidate that holds a phrase.
    longer = found.where(f"size(w) = {LONGEST}").select(
        "lang", F.col("a").alias("over"), F.explode(F.array(*[part(F.lit(k), F.lit(LONGEST - 1)) for k in (1, 2)])).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    stay = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * absorbed_percent)
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = stay.select("lang", "phrase", "a", "b.*", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    # A language may hold most phrases: only the first of each part of it are ranked together.
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    ranked = first.where(F.col("place") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    )
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
