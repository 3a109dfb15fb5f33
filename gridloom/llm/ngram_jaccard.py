"""Exact Jaccard metric-space join on word n-grams.

1 - Jaccard is a metric on shingle sets.  Documents alone make poor pivots in it: almost all
are at distance 1 from each other, and every border would have to be copied everywhere.  So
the first level takes the shingles themselves as pivots.  A document's region is that of its
rarest shingle; within the distance d of the join at most d of its shingles can be missing on
the other side, so it is copied, as a boundary document, into the regions of as many of its
next-rarest shingles as the window d allows, and into no others.  Two linked documents then
share a region.  Regions of one document end there.

Inside the regions documents are the pivots.  Every region names the document that shares most
with others, the distances to it are computed exactly, and what is within d is linked with it.
Regions whose documents are now one component are finished - groups of copies cost a row for
each copy, not a pair for each two.  In the others documents stay that can have a link to another
component: their windows share enough shingles, and this region is the first that both are in.
Large regions are then parted into the Voronoi cells of ``PIVOTS`` documents: each document goes to
its nearest pivot, at distance m, and as a boundary document into the cells of all pivots within
m + 2 d, so by the triangle inequality linked documents share a cell.  Cells are parted again as long
as that saves a quarter of the comparisons.

What is left is compared in tasks of bounded size: a cell is cut by the sizes of its sets (a link
joins equal or adjoining bands of sizes) and into parts of ``CELL_DOCS`` documents, and a task
holds two parts.  It returns a spanning forest of the links it finds, never pairs.  Parts of the
cell's largest component are not compared with each other.

Rarity is the place of a shingle's count in a sketch of bounded size (16 MB); any order gives the
same links.  Shingles that only one document copies are told by a filter of bounded size (32 MB)
before they are shuffled.  Texts are read again instead of keeping all sets: for the sketch, for
the regions, and for the sets of documents that share a region.

Defined cases: null and blank texts have an empty set and link with nothing; texts of fewer
words than a shingle are one shingle of all their words; equal sets are one node; rows with a
null id have no component; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.components import attach, components, roots
from gridloom.llm.words import MULTIPLIERS, hash_words, mixed

WORDS, SIMILARITY = 5, 80
#: Counters of the sketch: one for so many shingles, between the least and the most.
SHINGLES_PER_COUNTER, LEAST_SKETCH, MOST_SKETCH, SKETCH_PART = 8, 1 << 16, 1 << 24, 1 << 16
#: Places of the filters: so many for a key or node, between the least and the most.
PLACES_PER_KEY, LEAST_PLACES, MOST_PLACES, PLACE_PART = 8, 1 << 20, 1 << 28, 1 << 20
#: Documents that part a region into Voronoi cells.
PIVOTS = 4
#: Documents and shingles of one part of a cell; a task holds two parts.
CELL_DOCS, CELL_SHINGLES = 128, 1 << 20
#: Columns of a block of the incidence matrix of a cell.
COLUMNS = 1 << 14
#: Texts that are cut into shingles at a time.
TEXTS = 400


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text of a binary column."""
    each, counts, _ = hash_words(column)
    ends = np.cumsum(counts)
    span = max(len(each) - words + 1, 0)
    total = np.zeros(span, dtype=np.uint64)
    for k in range(words if span else 0):
        total = total * np.uint64(MULTIPLIERS[0]) + each[k : k + span]
        total ^= total >> np.uint64(29)
    total = mixed(total)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= words:
            out.append(np.unique(total[end - count : end - words + 1]))
        elif count:
            value = 1
            for word in each[end - count : end].tolist():
                value = (value * MULTIPLIERS[3] + word) % (1 << 64)
            out.append(np.array([value], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few texts: what is made of a text is several times its size."""
    for batch in batches:
        for begin in range(0, len(batch), TEXTS):
            yield batch.slice(begin, TEXTS)


def _power_of_two(wanted: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(wanted - 1, 0).bit_length()))


def _sketch_counts(words: int, sketch: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(sketch, dtype=np.uint8)
        for batch in _slices(batches):
            own = np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_sets(batch.column(0), words)])
            at, n = np.unique((own & np.uint64(sketch - 1)).astype(np.int64), return_counts=True)
            seen[at] = np.minimum(seen[at] + n, 255)
        for part, counts in enumerate(seen.reshape(-1, SKETCH_PART)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()])], names=["part", "counts"])

    return count


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, np.zeros(SKETCH_PART, dtype=np.int64)) + np.frombuffer(counts, dtype=np.uint8)
    for part, total in sums.items():
        level = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()])], names=["part", "counts"])


def rarity(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """Levels (log2) of the counts of all shingles, by their place in the sketch."""
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    sketch = _power_of_two(size // 6 // SHINGLES_PER_COUNTER, LEAST_SKETCH, MOST_SKETCH)
    parts = texts.mapInArrow(_sketch_counts(words, sketch), "part int, counts binary")
    sums = parts.repartition(min(64, sketch // SKETCH_PART), "part").mapInArrow(_sum_counts, "part int, counts binary")
    levels = np.zeros(sketch, dtype=np.uint8)
    for row in sums.toLocalIterator():  # MOST_SKETCH bytes in all
        levels[row.part * SKETCH_PART : (row.part + 1) * SKETCH_PART] = np.frombuffer(row.counts, dtype=np.uint8)
    return levels


def _signs(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    both = np.array([np.bitwise_xor.reduce(own * np.uint64(MULTIPLIERS[4])), np.sum(mixed(own))], dtype=np.uint64)
    return tuple(both.view(np.int64).tolist())


def prefix_size(size, similarity: int):
    """How many of its rarest shingles a document is copied by."""
    return size - (similarity * size + 99) // 100 + 1


def _regions(levels, words: int, similarity: int):
    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = levels.value, TaskContext.get().partitionId() << 33
        for batch in _slices(batches):
            sizes, ones, twos, keys, ends = [], [], [], [], [0]
            for own in shingle_sets(batch.column("text"), words):
                size = len(own)
                one, two = _signs(own) if size else (0, 0)
                sizes.append(size)
                ones.append(one)
                twos.append(two)
                window = prefix_size(size, similarity) if size else 0
                level = table[(own & np.uint64(len(table) - 1)).astype(np.int64)]
                keys.append(own[np.argsort(level, kind="stable")[:window]])
                ends.append(ends[-1] + window)
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(sizes))), batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()),
                    pa.array(ones, pa.int64()), pa.array(twos, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["row", "doc_id", "mark", "size", "one", "two", "keys"],
            )
            row += len(sizes)

    return regions


def _hit_places(places: int):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of a task's keys in the filter, by part; a place hit more often stands twice."""
        for batch in batches:
            at = batch.column(0).flatten().to_numpy().view(np.uint64) & np.uint64(places - 1)
            place, n = np.unique(at.astype(np.int64), return_counts=True)
            place = np.sort(np.concatenate([place, place[n > 1]]))
            cuts = np.searchsorted(place, np.arange(places // PLACE_PART + 1) * PLACE_PART)
            parts = [k for k in range(len(cuts) - 1) if cuts[k + 1] > cuts[k]]
            own = [(place[cuts[k] : cuts[k + 1]] - k * PLACE_PART).astype(np.int32).tobytes() for k in parts]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(own, pa.binary())], names=["part", "places"])

    return hits


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            count = seen.setdefault(part, np.zeros(PLACE_PART, dtype=np.uint8))
            at, n = np.unique(np.frombuffer(places, dtype=np.int32), return_counts=True)
            count[at] = np.minimum(count[at] + n, 2)
    for part, count in seen.items():
        bits = np.packbits(count == 2, bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()])], names=["part", "places"])


def shared_places(nodes: DataFrame) -> np.ndarray:
    """Bits of the places that keys of two or more nodes hit: at most ``MOST_PLACES``."""
    keys = nodes.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first()["n"]
    places = _power_of_two(PLACES_PER_KEY * keys, LEAST_PLACES, MOST_PLACES)
    hit = nodes.select("keys").mapInArrow(_hit_places(places), "part int, places binary")
    return _filter_of(hit.repartition(64, "part").mapInArrow(_twice, "part int, places binary"), places)


def _shared_keys(bits):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            lists = batch.column("keys")
            flat = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = (flat.view(np.uint64) & np.uint64(len(table) * 8 - 1)).astype(np.int64)
            hit = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            take = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[hit]), batch.column("node").take(take), batch.column("size").take(take)], names=["key", "node", "size"]
            )

    return keys


def _wanted_place(one: np.ndarray, doc_id: np.ndarray, places: int) -> np.ndarray:
    """Place in the filter of the document that stands for a node."""
    return (mixed(one.view(np.uint64) ^ mixed(doc_id.view(np.uint64))) & np.uint64(places - 1)).astype(np.int64)


def _wanted_places(places: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of documents, as lists by part of the filter."""
        for batch in batches:
            doc_id = batch.column("doc_id").fill_null(0).to_numpy()
            at = np.unique(_wanted_place(batch.column("one").to_numpy(), doc_id, places))
            parts, begins = np.unique(at // PLACE_PART, return_index=True)
            own = [(piece % PLACE_PART).astype(np.int32).tobytes() for piece in np.split(at, begins[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(own, pa.binary())], names=["part", "places"])

    return place


def _any(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(part, np.zeros(PLACE_PART, dtype=bool))[np.frombuffer(places, dtype=np.int32)] = True
    for part, hit in seen.items():
        bits = np.packbits(hit, bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()])], names=["part", "places"])


def _filter_of(parts: DataFrame, places: int) -> np.ndarray:
    """The bits of all parts of a filter, a part at a time."""
    bits, size = np.zeros(places // 8, dtype=np.uint8), PLACE_PART // 8
    for row in parts.toLocalIterator():
        bits[row.part * size : (row.part + 1) * size] = np.frombuffer(row.places, dtype=np.uint8)
    return bits


def _wanted_sets(bits, words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in _slices(batches):
            every = shingle_sets(batch.column("text"), words)
            doc_id = batch.column("doc_id").fill_null(0).to_numpy()
            one = np.array([_signs(own)[0] if len(own) else 0 for own in every], dtype=np.int64)
            at = _wanted_place(one, doc_id, len(table) * 8)
            hit = np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            own = [every[k] for k in hit if len(every[k])]
            signs = [_signs(o) for o in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in signs], pa.int64()), pa.array([b for _, b in signs], pa.int64()), pa.array([o.tobytes() for o in own], pa.binary())],
                names=["one", "two", "shingles"],
            )

    return sets


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by pivot, its own set first; the others are compared as they pass."""
    pivot, own = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        a, b, common_n, union_n = [], [], [], []
        ids = zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), strict=True)
        for (left, salt, right), held in zip(ids, batch.column("shingles"), strict=True):
            values = np.frombuffer(held.as_buffer(), dtype=np.uint64)
            if right is None:
                pivot, own = (left, salt), values.copy()
                continue
            if pivot != (left, salt):
                raise ValueError("a document came before its pivot")
            at = np.searchsorted(own, values)
            at[at == len(own)] = 0
            both = int(np.count_nonzero(own[at] == values))
            a.append(left)
            b.append(right)
            common_n.append(both)
            union_n.append(len(own) + len(values) - both)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, common_n, union_n)], names=["a", "b", "both", "either"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact sizes of intersection and union of pairs (a, b), compared at the pivot a.

    The set of a pivot goes to each of its salts once and never beside every partner."""
    heavy = common.heavy_of(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a", "n")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("_copies", F.lit(1))).cast("int")
    salted = pairs.join(F.broadcast(heavy), "a", "left").select("a", "b", salt.alias("salt"))
    partners = salted.join(sets.select(F.col("node").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
    pivots = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), "shingles"), "a")
    rows = partners.unionByName(pivots.select("a", "salt", F.lit(None).cast("bigint").alias("b"), "shingles"))
    spread = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return common.put(spread.mapInArrow(_compare, "a bigint, b bigint, both bigint, either bigint"), "verified")


def _similar(similarity: int) -> Column:
    return F.col("both") * 100 >= F.col("either") * similarity


def _key_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.sort(held.values.to_numpy().view(np.uint64)).tobytes() for held in batch.column("keys")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.binary())], names=["node", "shingles"])


class Join:
    """Tables that the rounds share."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, words: int, similarity: int):
        self.texts, self.nodes, self.words, self.similarity = texts, nodes, words, similarity
        self.keys = nodes.select("node", "keys").mapInArrow(_key_sets, "node bigint, shingles binary")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose windows share as many shingles as linked documents must.

        Documents of sizes m and n that are linked have t = s (m + n) / (1 + s) shingles in
        common; of those, windows of sizes p and q share at least min(p - m, q - n) + t."""
        shared = _verified(pairs, self.keys)
        sizes = self.nodes.select("node", "size")
        told = shared.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("m")), "a").join(
            sizes.select(F.col("node").alias("b"), F.col("size").alias("n")), "b"
        )
        s = self.similarity
        over = F.least(prefix_size_of("m", s) - F.col("m"), prefix_size_of("n", s) - F.col("n"))
        least = over + F.ceil((F.col("m") + F.col("n")) * s / F.lit(100 + s) - F.lit(1e-9))
        return common.put(told.where(F.col("both") >= least).select("a", "b"), "possible")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """Exact sizes of intersection and union of the pairs that are possible."""
        possible = self.possible(pairs)
        sets = self.sets(possible.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        found = _verified(possible, sets)
        for table in (possible, sets):
            common.drop(table)
        return found

    def sets(self, wanted: DataFrame) -> DataFrame:
        """Shingle sets ``(node, shingles)`` of some nodes, from the texts that stand for them."""
        spark = self.texts.sparkSession
        told = common.put(wanted.join(self.nodes.select("node", "one", "two", "doc_id"), "node"), "wanted")
        places = _power_of_two(PLACES_PER_KEY * 2 * told.count(), LEAST_PLACES, MOST_PLACES)
        own = told.select("one", "doc_id").mapInArrow(_wanted_places(places), "part int, places binary")
        hit = _filter_of(own.repartition(64, "part").mapInArrow(_any, "part int, places binary"), places)
        bits = spark.sparkContext.broadcast(hit)
        sets = self.texts.mapInArrow(_wanted_sets(bits, self.words), "one bigint, two bigint, shingles binary")
        # Repeated rows give their set more than once.
        found = common.put(
            sets.join(told, ["one", "two"]).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets"
        )
        bits.destroy()
        common.drop(told)
        return found

    def pivot_round(self, regions: DataFrame) -> DataFrame:
        """Sizes of intersection and union of each region's pivot with its documents.

        The pivot is the document that shares most with others, as the one does of which the
        others are copies."""
        most = regions.groupBy("node").agg((-F.sum("n")).alias("h"))
        pivots = common.put(
            regions.join(most, "node").groupBy("key").agg(
                F.min(F.struct("h", "node", "size")).alias("p"), F.count(F.lit(1)).alias("n")
            ).select("key", F.col("p.node").alias("pivot"), F.col("p.size").alias("pivot_size"), "n"),
            "pivots",
        )
        named = common.lookup(regions.select("key", "node", "size"), pivots, "key", "n")
        s = self.similarity
        sizes = F.least("size", "pivot_size") * 100 >= F.greatest("size", "pivot_size") * s
        pairs = named.where(sizes & (F.col("node") != F.col("pivot"))).select(
            F.col("pivot").alias("a"), F.col("node").alias("b")
        ).distinct()
        return self.measured(common.put(pairs, "pairs"))

    def related(self, regions: DataFrame) -> DataFrame:
        """Rows ``(cell, node, size, class)`` of open regions whose windows allow a link to a
        document of another component, in the first region that both are in."""
        rows = regions.select(F.col("key").alias("cell"), "node", "size", "class")
        told = _in_cells(rows, self.keys, self.similarity, _allowed(self.similarity), "cell bigint, node bigint")
        return common.put(
            rows.join(told.distinct(), ["cell", "node"], "left_semi"), "related"
        )

    def parted(self, cells: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Large cells as Voronoi cells of some of their documents; and the links found on the way."""
        reach = 2 * (1 - self.similarity / 100) + 1e-9
        links = None
        done, todo = [], cells
        while True:
            size = todo.groupBy("cell").agg(
                F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high")
            )
            size = common.put(size.where("low <> high").select("cell", "n"), "cells")
            todo = common.put(common.lookup(todo, size, "cell", "n"), "sized")
            done.append(todo.where(F.col("n") <= 2 * CELL_DOCS).drop("n"))
            large = todo.where(F.col("n") > 2 * CELL_DOCS)
            if large.isEmpty():
                break
            h = F.xxhash64("node", "cell", F.lit(len(done)))
            slots = large.groupBy("cell", F.pmod(h, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(h, "node")).alias("p"))
            pivots = slots.groupBy("cell").agg(F.collect_list("p.node").alias("pivots"))  # PIVOTS at most
            pivots = common.put(pivots.join(size, "cell"), "pivots")
            named = common.lookup(large.drop("n"), pivots, "cell", "n")
            named = common.put(named.select("*", F.explode("pivots").alias("a")).drop("pivots"), "named")
            found = _verified(named.select("a", F.col("node").alias("b")).distinct(), sets)
            new = common.put(_similar_pairs(found, self.similarity), "links")
            links = new if links is None else links.unionByName(new)
            away = found.select("a", F.col("b").alias("node"), (1 - F.col("both") / F.col("either")).alias("away"))
            placed = named.join(away, ["a", "node"]).groupBy("cell", "node", "size", "class", "n").agg(
                F.collect_list(F.struct("away", "a")).alias("to")  # one for each pivot
            )
            near = F.filter("to", lambda p: p["away"] <= F.array_min("to")["away"] + reach)
            moved = common.put(placed.select("cell", "node", "size", "class", "n", F.explode(near).alias("to")), "moved")
            # A cell stays whole where cells of its own would not save a quarter of the comparisons.
            child = moved.groupBy("cell", "n", "to.a").agg(F.count(F.lit(1)).alias("m"))
            saved = child.groupBy("cell", "n").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("after"))
            saved = common.put(saved.where("4 * after <= 3D * n * n").select("cell", "n"), "saved")
            split = common.lookup(moved.drop("n"), saved, "cell", "n")
            whole = large.select("cell", "node", "size", "class").join(saved.select("cell"), "cell", "left_anti")
            done.append(common.put(whole, "whole"))
            todo = common.put(split.select(F.xxhash64("cell", "to.a").alias("cell"), "node", "size", "class"), "split")
        rows = done[0]
        for more in done[1:]:
            rows = rows.unionByName(more)
        return rows, links

    def linked(self, regions: DataFrame) -> DataFrame | None:
        """Links ``(a, b)`` that join the components of open regions as far as they are linked."""
        cells = self.related(regions)
        if cells.isEmpty():
            return None
        sets = self.sets(cells.select("node").distinct())
        cells, on_the_way = self.parted(cells, sets)
        links = common.put(_in_cells(cells, sets, self.similarity, _links(self.similarity), "a bigint, b bigint"), "links")
        return links if on_the_way is None else links.unionByName(on_the_way)


def prefix_size_of(size: str, similarity: int) -> Column:
    return F.col(size) - F.floor((F.col(size) * similarity + 99) / 100) + 1


def _similar_pairs(found: DataFrame, similarity: int) -> DataFrame:
    return found.where(_similar(similarity)).where("a <> b").select("a", "b")


def _in_cells(rows: DataFrame, held: DataFrame, similarity: int, compare, schema: str) -> DataFrame:
    """What ``compare`` makes of the cells of rows ``(cell, node, size, class)`` and their sets.

    A document is at home in the band of its size and a guest in the band below; a cell is compared
    band by band.  Where a band is too much for a task, its rows are dealt over parts and each two parts
    are one task; the parts of its largest component are compared with the others only."""
    base = math.log(max(100 / similarity, 1.01)) * (1 + 1e-9)
    band = F.floor(F.log("size") / F.lit(base))
    banded = rows.select("*", F.explode(F.array(band, band - 1)).alias("band"), band.alias("home"))
    by_class = banded.groupBy("cell", "band", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"),
        F.sum((F.col("home") == F.col("band")).cast("bigint")).alias("homes"),
    )
    tasks = by_class.groupBy("cell", "band").agg(
        F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.sum("homes").alias("homes"),
        F.max(F.struct("n", "weight", "class")).alias("main"), F.count(F.lit(1)).alias("classes"),
    ).where("classes > 1 AND homes > 0")
    parts = lambda n, weight: F.greatest(F.ceil(n / CELL_DOCS), F.ceil(weight / CELL_SHINGLES))
    name = F.concat_ws(".", "cell", "band").alias("name")
    tasks = common.put(
        tasks.select(
            name, "n", F.col("main.class").alias("main"),
            F.when((F.col("n") <= 2 * CELL_DOCS) & (F.col("weight") <= 2 * CELL_SHINGLES), 0)
            .otherwise(parts(F.col("main.n"), F.col("main.weight"))).alias("mains"),
            F.when((F.col("n") <= 2 * CELL_DOCS) & (F.col("weight") <= 2 * CELL_SHINGLES), 1)
            .otherwise(parts(F.col("n") - F.col("main.n"), F.col("weight") - F.col("main.weight"))).alias("others"),
        ), "tasks",
    )
    dealt = common.lookup(banded.select("*", name), tasks, "name", "n")
    is_main = (F.col("class") == F.col("main")) & (F.col("mains") > 0)
    h = F.xxhash64("node", F.lit(1))
    part = F.when(is_main, F.pmod(h, F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(h, F.greatest("others", F.lit(1))))
    last = F.col("mains") + F.col("others") - 1
    other = F.explode(F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0)), last))
    spread = dealt.select(
        "cell", "band", "node", "size", "class", (F.col("home") == F.col("band")).alias("home"), part.alias("part"), other.alias("other")
    )
    placed = spread.select(
        "cell", "band", "node", "size", "class", "home", F.least("part", "other").alias("one"),
        F.greatest("part", "other").alias("two"), (F.col("part") <= F.col("other")).alias("left"),
    )
    full = attach(placed, held, "node", "inner")
    where = ["cell", "band", "one", "two"]
    return full.repartition(*where).sortWithinPartitions(*where).mapInArrow(compare, schema)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one task of a cell at a time."""
    where, rest = ["cell", "band", "one", "two"], None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        names = np.stack([table.column(c).to_numpy() for c in where])
        begins = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist()]
        for begin, end in zip(begins, begins[1:], strict=False):
            yield table.slice(begin, end - begin)
        rest = table.slice(begins[-1])
    if rest is not None:
        yield rest


def _sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Elements of the sets of a cell, and the row of each."""
    own = [np.frombuffer(held.as_buffer(), dtype=np.uint64) for held in table.column("shingles")]
    return np.concatenate(own), np.repeat(np.arange(len(own)), [len(o) for o in own])


def _shared(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many elements each two of n sets share."""
    total = np.zeros((n, n))
    values, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    several = counts[at] > 1
    column = (np.cumsum(counts > 1) - 1)[at[several]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[several][order]
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, COLUMNS):
        begin, end = np.searchsorted(column, [low, low + COLUMNS])
        block = np.zeros((n, min(COLUMNS, width - low)), dtype=np.float32)
        block[owner[begin:end], column[begin:end] - low] = 1
        total += block @ block.T
    return total


def _open(table: pa.Table) -> np.ndarray:
    """Which two rows of a cell are to be compared here."""
    label, home, left = (table.column(c).to_numpy() for c in ("class", "home", "left"))
    both_parts = table.column("one")[0] == table.column("two")[0]
    open_pairs = (label[:, None] != label) & (home[:, None] | home)
    return open_pairs if both_parts else open_pairs & (left[:, None] != left)


def _allowed(similarity: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents whose windows share as many shingles with another's as linked documents must.

        Documents of sizes m and n that are linked have t = s (m + n) / (1 + s) shingles in
        common; of those, windows of sizes p and q share at least min(p - m, q - n) + t."""
        for table in _cells(batches):
            pairs, size = _open(table), table.column("size").to_numpy()
            pairs &= np.minimum.outer(size, size) * 100 >= np.maximum.outer(size, size) * similarity
            if not pairs.any():
                continue
            flat, owner = _sets_of(table)
            over = prefix_size(size, similarity) - size
            least = np.minimum.outer(over, over) + np.ceil(np.add.outer(size, size) * similarity / (100 + similarity) - 1e-9)
            key = table.column("cell").to_numpy()[:1].view(np.uint64)[0]
            before = flat < key
            pairs &= (_shared(flat, owner, len(size)) >= least) & (_shared(flat[before], owner[before], len(size)) == 0)
            hit = pa.array(np.flatnonzero(pairs.any(axis=0)))
            if len(hit):
                found = table.select(["cell", "node"]).take(hit).combine_chunks()
                yield from found.to_batches()

    return compare


def _links(similarity: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the links of each task."""
        for table in _cells(batches):
            pairs, size = _open(table), table.column("size").to_numpy()
            pairs &= np.minimum.outer(size, size) * 100 >= np.maximum.outer(size, size) * similarity
            if not pairs.any():
                continue
            flat, owner = _sets_of(table)
            both = _shared(flat, owner, len(size))
            pairs &= both * 100 >= (np.add.outer(size, size) - both) * similarity
            one, two = np.nonzero(np.triu(pairs))
            if len(one):
                node = table.column("node").to_numpy()
                nodes, root = roots(node[one], node[two])
                other = nodes != root
                yield pa.RecordBatch.from_arrays([pa.array(root[other]), pa.array(nodes[other])], names=["a", "b"])

    return compare


def _unfinished(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the regions whose documents are not one component yet."""
    classed = regions.join(classes.withColumnRenamed("component", "class"), "node", "left").withColumn(
        "class", F.coalesce("class", "node")
    )
    classed = common.put(classed.drop("n"), "classed")
    open_keys = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n"))
    # Of two documents one is the pivot: nothing is left to compare.
    open_keys = common.put(open_keys.where("low <> high AND n > 2").select("key", "n"), "open")
    return common.put(common.lookup(classed, open_keys, "key", "n"), "left")


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, text_mark)`` of every row; similarity in hundredths.

    ``text_mark`` is a 64-bit hash of the text, which tells rows of one id apart."""
    return _classes(docs, id_col, text_col, words, similarity).drop("head")


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """``jaccard_classes`` with ``head``: whether the row is the first of its class by (id, text)."""
    spark = docs.sparkSession
    common.ship(spark)
    text = F.col(text_col).cast("binary")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    levels = spark.sparkContext.broadcast(rarity(texts.select("text"), words))
    told = common.put(
        texts.mapInArrow(
            _regions(levels, words, similarity),
            "row bigint, doc_id bigint, mark bigint, size bigint, one bigint, two bigint, keys array<bigint>",
        ),
        "regions",
    )
    # Equal sets are one node, named by the first row that has it.
    alike = ["one", "two", "size"]
    first = F.min_by(F.struct("keys", "doc_id"), "row").alias("first")
    nodes = common.put(
        told.where("size > 0").groupBy(*alike).agg(F.min("row").alias("node"), first).select(
            "node", *alike, "first.keys", "first.doc_id"
        ),
        "nodes",
    )
    sign = F.concat_ws(".", *alike)
    own = F.when(F.col("size") > 0, sign).otherwise(F.concat(F.lit("row"), "row"))
    rows = common.put(told.select("doc_id", "mark", "size", own.alias("sign")), "rows")
    common.drop(told)
    levels.destroy()
    bits = spark.sparkContext.broadcast(shared_places(nodes))
    copies = nodes.select("keys", "node", "size").mapInArrow(_shared_keys(bits), "key bigint, node bigint, size bigint")
    copies = common.put(copies, "copies")
    bits.destroy()
    regions = common.put(copies.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    left = common.put(common.lookup(copies, regions, "key", "n"), "shared")
    common.drop(copies)

    join = Join(texts, nodes, words, similarity)
    links = common.put(_similar_pairs(join.pivot_round(left), similarity), "links")
    classes = components(links)
    left = _unfinished(left, classes)
    if not left.isEmpty():
        more = join.linked(left)
        if more is not None:
            classes = components(links.unionByName(more))
    # Rows find their node by its 128-bit sign and size.
    named = nodes.join(classes, "node", "left").select(sign.alias("sign"), F.coalesce("component", "node").alias("class"))
    classed = attach(rows, common.put(named, "signs"), "sign")
    classed = common.put(
        classed.select("doc_id", "mark", "size", F.coalesce(F.col("class").cast("string"), "sign").alias("class")), "classed"
    )
    lowest = common.put(
        classed.groupBy("class").agg(
            F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("n"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("first"),
        ), "lowest",
    )
    return common.lookup(classed, lowest, "class", "n").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("lowest")).alias("component_id"),
        F.col("mark").alias("text_mark"),
        F.coalesce((F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")), F.lit(False)).alias("head"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all their columns, one of each class of near duplicates: that of the
    smallest id.  Rows of one id whose texts are not linked are of different classes.  Documents
    with a null id have no class and stay."""
    classes = common.put(_classes(docs, id_col, text_col), "classes")
    mark = F.xxhash64(F.col(text_col).cast("binary"))
    own_id, own_mark = common.own(docs, "id"), common.own(docs, "mark")
    here = (F.col(id_col) == F.col(own_id)) & (mark == F.col(own_mark))
    named = [F.col("doc_id").alias(own_id), F.col("text_mark").alias(own_mark)]
    gone = classes.where("doc_id IS NOT NULL AND NOT head").select(*named)
    kept = docs.join(gone.distinct(), here, "left_anti")
    # Rows that agree in id and text are one class: all but one of them go.
    heads = classes.where("head AND n_shingles > 0").groupBy(*named).agg(F.count(F.lit(1)).alias("_n"))
    twins = common.put(heads.where("_n > 1").select(own_id, own_mark), "twins")
    if twins.isEmpty():
        return kept
    several = kept.join(twins, here, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twins, here, "left_anti").unionByName(several)
