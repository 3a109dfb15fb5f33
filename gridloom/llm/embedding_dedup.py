"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine >= c lie within squared distance 2 - 2c.  A random rotation (signs and
a Hadamard transform, which is exact to repeat) spreads every vector evenly, and its
coordinates are split into blocks: in at least one of them two such vectors lie within the
block's share of the squared distance.  Each block is range-joined for itself: a grid over its
first coordinates gives every vector a home cell and, as a guest, the cells its range touches;
vectors of one cell are compared in the block, and the pairs in range are verified by the
cosine of the original vectors in double precision.  A pair is taken in the first block that
has it in range, where homes and guests meet once, so no pair is counted twice.

Equal vectors are grouped first and stand as one.  A cell gives one row per vector - how many
vectors it links with, and a root it is joined with - never the pairs.  Cells with more than
``CHUNK`` vectors are cut, and every two chunks meet in a task of their own, so tasks stay
small and no link is lost.  The grid takes more coordinates the more vectors a label has.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and rows
without label, have no links and are components of their own; vectors of other lengths than
each other's are not compared; repeated rows are vectors of their own with links to each
other (rows with one id count once each); an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.components import attach, components, roots

COSINE = 0.98
BLOCKS = 8
CHUNK = 2000
#: Width of a grid cell in ranges of a block.
WIDTH = 4.0
SEED = 11
SLACK = 1e-9


def rotate(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows times random signs and a Hadamard matrix: additions in a fixed order, so that a
    vector comes out the same in any task."""
    size = max(BLOCKS, 1 << (unit.shape[1] - 1).bit_length())
    out = np.zeros((len(unit), size))
    out[:, : unit.shape[1]] = unit * np.random.default_rng(seed).choice([-1.0, 1.0], unit.shape[1])
    half = 1
    while half < size:
        pair = out.reshape(len(out), -1, 2, half)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(out), size)
        half *= 2
    return out / np.sqrt(size)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.sum(vectors * vectors, axis=1, keepdims=True))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _windows(budget: float, grid: int):
    """Home cell and guest cells of every vector in every block."""
    reach = np.sqrt(budget / BLOCKS) * (1 + SLACK) + SLACK
    width = WIDTH * reach

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            for dim in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                turned = rotate(_units(_vectors(part.column("vector"))))
                blocks = turned.reshape(len(part), BLOCKS, -1)
                used = min(grid, blocks.shape[2])
                head = blocks[:, :, :used]
                powers = 256 ** np.arange(used, dtype=np.int64)
                home = (np.floor(head / width).astype(np.int64) + 128) @ powers
                low = np.floor((head - reach) / width).astype(np.int64) + 128
                high = np.floor((head + reach) / width).astype(np.int64) + 128
                rows, block_no, cell, is_home = [], [], [], []
                at, block = np.indices(home.shape)
                rows.append(at.ravel()), block_no.append(block.ravel())
                cell.append(home.ravel()), is_home.append(np.ones(home.size, dtype=bool))
                for choice in range(1 << used):
                    take_high = np.array([choice >> k & 1 for k in range(used)], dtype=bool)
                    corner = np.where(take_high, high, low)
                    there = corner @ powers
                    # Each touched cell once: the high side only where it differs from the low.
                    new = np.all(~take_high | (high != low), axis=2) & (there < home)
                    rows.append(at[new]), block_no.append(block[new])
                    cell.append(there[new]), is_home.append(np.zeros(int(new.sum()), dtype=bool))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label").take(take), pa.array(np.full(len(take), dim, dtype=np.int32)),
                        pa.array(np.concatenate(block_no).astype(np.int32)), pa.array(np.concatenate(cell)),
                        pa.array(np.concatenate(is_home)), part.column("rep").take(take),
                        part.column("n").take(take), part.column("vector").take(take),
                    ],
                    names=["label", "dim", "block", "cell", "home", "rep", "n", "vector"],
                )

    return cells


def _join_cell(cosine: float, budget: float):
    share = budget / BLOCKS + SLACK
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def near(left: np.ndarray, right: np.ndarray, vectors, turned, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places (left, right) that are in range first in this block and verified."""
        found_a, found_b = [], []
        own = turned[:, block]
        for begin in range(0, len(left), 256):
            rows = left[begin : begin + 256]
            apart = np.sum(own[rows] ** 2, axis=1)[:, None] + np.sum(own[right] ** 2, axis=1) - 2 * own[rows] @ own[right].T
            close = vectors[rows] @ vectors[right].T >= cosine - 1e-6
            i, j = np.nonzero(close & (apart <= share + 1e-6))
            for cut in range(0, len(i), 20_000):
                a, b = rows[i[cut : cut + 20_000]], right[j[cut : cut + 20_000]]
                parts = np.sum((turned[a] - turned[b]) ** 2, axis=2) <= share
                keep = parts[:, block] & ~np.any(parts[:, :block], axis=1)
                keep &= np.sum(vectors[a] * vectors[b], axis=1) >= cosine
                found_a.append(a[keep])
                found_b.append(b[keep])
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, n = table["rep"].to_numpy(), table["n"].to_numpy()
        home, chunk = table["home"].to_numpy(), table["chunk"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        block = table["block"][0].as_py()
        vectors = _units(_vectors(table["vector"].combine_chunks() if table["vector"].num_chunks != 1 else table["vector"].chunk(0)))
        turned = rotate(vectors).reshape(len(rep), BLOCKS, -1)
        pairs = []
        if low == high:
            at_home, guests = np.flatnonzero(home), np.flatnonzero(~home)
            a, b = near(at_home, at_home, vectors, turned, block)
            pairs = [(a[a < b], b[a < b]), near(at_home, guests, vectors, turned, block)]
        else:
            one, two = chunk == low, chunk == high
            for left, right in ((one & home, two & home), (one & home, two & ~home), (two & home, one & ~home)):
                pairs.append(near(np.flatnonzero(left), np.flatnonzero(right), vectors, turned, block))
        a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
        if not len(a):
            return out.empty_table()
        links = np.bincount(a, weights=n[b], minlength=len(rep)) + np.bincount(b, weights=n[a], minlength=len(rep))
        nodes, root = roots(rep[a], rep[b])
        place = {int(r): k for k, r in enumerate(nodes)}
        total = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(total, [place[int(r)] for r in rep[links > 0]], links[links > 0].astype(np.int64))
        return pa.table([pa.array(nodes), pa.array(root), pa.array(total)], schema=out)

    return join


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    common.ship(vectors.sparkSession)
    budget = 2 - 2 * cosine
    vector = F.col(vector_col)
    usable = F.coalesce(
        F.col(label_col).isNotNull() & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )
    row = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"),
        F.when(usable, F.concat(F.hex(F.xxhash64(label_col, vector_col)), F.lit("."), F.hex(F.xxhash64(F.lit(5), vector_col, label_col)))).alias("key"),
    )
    groups = common.put(
        row.where("key IS NOT NULL").groupBy("key").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")
        ),
        "vectors",
    )
    most = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    # A cell is 4 ranges wide, so each coordinate of the grid halves the vectors of a cell.
    grid = int(np.clip(np.ceil(np.log2(max(most, 1) / 500.0)), 1, 6))
    told = groups.select("label", "rep", "n", "vector")
    kinds = dict(told.dtypes)
    windows = common.put(
        told.mapInArrow(
            _windows(budget, grid),
            f"label {kinds['label']}, dim int, block int, cell bigint, home boolean, rep bigint, n bigint, vector {kinds['vector']}",
        ),
        "windows",
    )
    cell = ["label", "dim", "block", "cell"]
    large = windows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks")).where("chunks > 1")
    chunks = F.coalesce("chunks", F.lit(1))
    dealt = (
        windows.join(large, cell, "left")
        .withColumn("chunk", F.pmod(F.xxhash64("rep", "home"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumn("low", F.least("chunk", "other"))
        .withColumn("high", F.greatest("chunk", "other"))
    )
    met = common.put(
        dealt.groupBy(*cell, "low", "high").applyInArrow(_join_cell(cosine, budget), "a bigint, b bigint, n bigint"), "near"
    )
    across = met.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    classes = components(met.select("a", "b"))
    reps = (
        groups.select("key", "rep", "n")
        .join(across, "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = attach(row.where("key IS NOT NULL").select("vec_id", "key"), common.put(reps, "classes"), "key", "inner")
    alone = row.where("key IS NULL").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
