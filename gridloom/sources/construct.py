"""Building tensors and factor tables from ordinary tables."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import hash_normal, hash_uniform, required
from gridloom.tensor import Shape, TensorFrame, mode_col

# Cells per block when a dense tensor is written out.
BLOCK = 64
# Numbers per task of a generated range, and the most tasks it is split into.
PART_ROWS = 1 << 23
MOST_PARTS = 100_000


def _inside(index: Column, name: str, shape: Shape | None, m: int) -> Column:
    """The index, which fails the job where it lies outside a given shape."""
    if shape is None:
        return index
    outside = F.raise_error(F.lit(f"index of {name} outside 0..{shape[m] - 1}"))
    return F.when((index >= 0) & (index < F.lit(shape[m])), index).otherwise(outside.cast("bigint"))


def from_coo(
    df: DataFrame,
    idx_cols: Sequence[str],
    value_col: str,
    shape: Shape | None = None,
) -> TensorFrame:
    """Tensor from a table of cells; cells given more than once are summed.

    Null indexes or values fail the job, and so does an index outside a given
    shape.  Without a shape the extents are the largest indexes plus one.
    """
    cols = []
    for m, name in enumerate(idx_cols):
        index = required(F.col(name).cast("bigint"), f"null index in {name}", "bigint")
        cols.append(_inside(index, name, shape, m).alias(mode_col(m)))
    value = required(F.col(value_col).cast("double"), f"null value in {value_col}", "double")
    names = [mode_col(m) for m in range(len(idx_cols))]
    rows = df.select(*cols, value.alias("value"))
    cells = rows.groupBy(*names).agg(F.sum("value").alias("value"))
    # Extents are read off the rows before the grouping: no shuffle of cells.
    measure = TensorFrame(rows)._measure if shape is None else tuple(shape)
    return TensorFrame(cells, measure, unique=True)


def empty_tensor(spark: SparkSession, shape: Shape) -> TensorFrame:
    fields = ", ".join(f"{mode_col(m)} bigint" for m in range(len(shape)))
    return TensorFrame(spark.createDataFrame([], f"{fields}, value double"), tuple(shape), unique=True)


def from_arrays(df: DataFrame, id_col: str, array_col: str, shape: Shape | None = None) -> TensorFrame:
    """Matrix whose rows are arrays: every element becomes a stored cell, zeros too.

    Ids and places outside a given shape fail the job, as in ``from_coo``."""
    cells = df.select(
        F.col(id_col).cast("bigint").alias("i0"),
        F.posexplode(F.col(array_col)).alias("i1", "value"),
    )
    cells = cells.select(
        _inside(required(F.col("i0"), f"null index in {id_col}", "bigint"), id_col, shape, 0).alias("i0"),
        _inside(F.col("i1").cast("bigint"), array_col, shape, 1).alias("i1"),
        required(F.col("value").cast("double"), f"null value in {array_col}", "double").alias("value"),
    )
    return TensorFrame(cells, shape)


def from_vector(df: DataFrame, id_col: str, value_col: str, length: int | None = None) -> TensorFrame:
    return from_coo(df, [id_col], value_col, None if length is None else (length,))


def _strides(shape: Shape) -> list[int]:
    return [prod(shape[m + 1 :]) for m in range(len(shape))]


def _check_cells(shape: Shape) -> int:
    cells = prod(shape)
    if cells >= 1 << 63:
        raise ValueError(f"shape {shape} has more cells than a bigint can number")
    return cells


def _decode(cell, shape: Shape):
    """Indexes of a cell number, last mode fastest."""
    return [
        F.expr(f"({cell} div {step}L) % {n}L").alias(mode_col(m))
        for m, (n, step) in enumerate(zip(shape, _strides(shape), strict=True))
    ]


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    """0..n-1 in parts of at most ``PART_ROWS`` numbers, as long as that is not too many parts."""
    parts = max(spark.sparkContext.defaultParallelism, min(-(-n // PART_ROWS), MOST_PARTS))
    return spark.range(0, n, 1, parts)


def index_grid(spark: SparkSession, shape: Shape) -> DataFrame:
    """All coordinates of a shape: one range of cell numbers, split evenly over
    the tasks and decoded by division, so that no product of tables is taken."""
    cells = _check_cells(shape)
    return _numbers(spark, cells).select(*_decode("id", shape)) if cells else empty_tensor(spark, shape).frame.drop("value")


def densify(tensor: TensorFrame) -> TensorFrame:
    """Every cell of the shape, absent ones as 0.0.

    The grid is not shuffled: stored cells are packed into blocks of ``BLOCK``
    neighbouring cell numbers, met with the range of block numbers, and each
    block is unfolded where it lies.  Coordinates given twice are summed first.
    """
    shape = tensor.shape
    cells = _check_cells(shape)
    if not cells:
        return empty_tensor(tensor.spark, shape)
    number = " + ".join(
        [f"{c} * {step}L" for c, step in zip(tensor.index_cols, _strides(shape), strict=True)]
    )
    frame = tensor.frame
    if not tensor.unique:
        frame = frame.groupBy(*tensor.index_cols).agg(F.sum("value").alias("value"))
    inside = " and ".join(f"{c} between 0 and {n - 1}" for c, n in zip(tensor.index_cols, shape, strict=True))
    checked = f"if({inside}, {number}, raise_error('coordinate outside the shape'))"
    packed = (
        frame.select(F.expr(checked).cast("bigint").alias("cell"), "value")
        .groupBy(F.expr(f"cell div {BLOCK}").alias("block"))
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct((F.col("cell") % BLOCK).cast("int").alias("k"), "value"))
            ).alias("stored")
        )
    )
    blocks = _numbers(tensor.spark, -(-cells // BLOCK)).select(F.col("id").alias("block"))
    unfolded = (
        blocks.join(packed, "block", "left")
        .select("block", "stored", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))).alias("k"))
        .select(
            (F.col("block") * BLOCK + F.col("k")).alias("cell"),
            F.coalesce(F.try_element_at("stored", F.col("k")), F.lit(0.0)).alias("value"),
        )
        .where(F.col("cell") < F.lit(cells))
    )
    return TensorFrame(unfolded.select(*_decode("cell", shape), "value"), shape, unique=True)


def slice_batches(tensor: TensorFrame, mode: int, batch_size: int) -> DataFrame:
    """Cells tagged with the batch their index on ``mode`` falls in and re-based
    to the start of that batch: ``(batch, i0.., value)``, one scan for all."""
    col = tensor.index_cols[mode]
    return tensor.frame.select(
        F.expr(f"{col} div {int(batch_size)}").alias("batch"),
        *[
            F.expr(f"{c} % {int(batch_size)}L").alias(c) if c == col else F.col(c)
            for c in tensor.index_cols
        ],
        "value",
    )


def slice_window(tensor: TensorFrame, mode: int, low: int, high: int) -> TensorFrame | None:
    """The slices ``[low, high)`` of a mode, re-based to 0; the last window is cut
    short at the extent, and past it there is none."""
    shape = tensor.shape
    high = min(high, shape[mode])
    if low >= high:
        return None
    col = tensor.index_cols[mode]
    rows = tensor.frame.where((F.col(col) >= low) & (F.col(col) < high))
    rows = rows.withColumn(col, F.col(col) - F.lit(low).cast("bigint"))
    new_shape = shape[:mode] + (high - low,) + shape[mode + 1 :]
    return TensorFrame(rows, new_shape, tensor.unique, tensor.stored)


def random_rows(
    spark: SparkSession, mode: int, length: int, rank: int, seed: int, dist: str = "uniform"
) -> DataFrame:
    """``(idx, f0..)`` for one mode, each number fixed by (seed, mode, idx, r)."""
    draw = {"uniform": hash_uniform, "normal": hash_normal}[dist]
    idx = F.col("id").cast("string")
    return spark.range(length).select(
        F.col("id").alias("idx"), *[draw(seed, mode, idx, r).alias(f"f{r}") for r in range(rank)]
    )


def random_factors(
    spark: SparkSession, shape: Shape, rank: int, seed: int = 6, dist: str = "uniform"
) -> list[DataFrame]:
    """One factor table ``(idx, vec)`` per mode with uniform(0,1) or normal(0,1) numbers."""
    from gridloom.operators.factors import pack

    return [pack(random_rows(spark, m, n, rank, seed, dist), rank) for m, n in enumerate(shape)]
