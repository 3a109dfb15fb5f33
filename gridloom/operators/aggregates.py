"""Counts, norms, slice weights. Scalars come as one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import is_close, ratio
from gridloom.operators.modes import none_of
from gridloom.tensor import TensorFrame, require_same


def nnz(tensor: TensorFrame) -> DataFrame:
    """Stored cells, explicit zeros included."""
    return tensor.frame.agg(F.count(F.lit(1)).alias("nnz"))


def square_norm(frame: DataFrame):
    return F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0))


def norm(tensor: TensorFrame) -> DataFrame:
    return tensor.frame.agg(F.sqrt(square_norm(tensor.frame)).alias("norm"))


def normalize(vector: TensorFrame) -> tuple[TensorFrame, DataFrame]:
    """The vector scaled to length 1, and its norm; a zero vector stays zero.

    The norm enters as a scalar subquery, so scaling is a plain projection.
    """
    length = norm(vector)
    scaled = vector.frame.select(
        *vector.index_cols, ratio(F.col("value"), length.scalar()).alias("value")
    )
    return TensorFrame(scaled, vector._shape, vector.unique), length


def slice_weights(tensor: TensorFrame, complete: bool = True) -> DataFrame:
    """``(mode, idx, w)``: the sum of squares of every slice of every mode.

    One scan: each cell is expanded to its indexes and summed before the shuffle,
    so a slice holding a large part of the cells costs one row per task.  With
    ``complete`` the slices without cells follow with weight 0.
    """
    index_of = ", ".join(f"{m}, {c}" for m, c in enumerate(tensor.index_cols))
    sums = (
        tensor.frame.select(
            (F.col("value") * F.col("value")).alias("w"),
            F.expr(f"stack({tensor.n_modes}, {index_of}) as (mode, idx)"),
        )
        .groupBy("mode", "idx")
        .agg(F.sum("w").alias("w"))
    )
    if not complete:
        return sums
    spark = tensor.spark
    slots = None
    for m, n in enumerate(tensor.shape):
        part = spark.range(n).select(F.lit(m).alias("mode"), F.col("id").alias("idx"))
        slots = part if slots is None else slots.unionByName(part)
    return slots.join(sums, ["mode", "idx"], "left").select(
        "mode", "idx", F.coalesce("w", F.lit(0.0)).alias("w")
    )


def merge_weights(weights: DataFrame, added: DataFrame, mode: int, offset: int) -> DataFrame:
    """Weights after an append: summed on the shared modes, the new slices of the
    growing mode placed from ``offset`` on."""
    grows = F.col("mode") == mode
    moved = added.select(
        "mode",
        F.when(grows, F.col("idx") + F.lit(offset).cast("bigint")).otherwise(F.col("idx")).alias("idx"),
        "w",
    )
    return weights.unionByName(moved).groupBy("mode", "idx").agg(F.sum("w").alias("w"))


def all_close(t: TensorFrame, u: TensorFrame, tol: float = 1e-6) -> DataFrame:
    """One row: are all cells within ``tol`` of each other, absent ones being 0.

    The cells of one tensor are laid over the negated cells of the other and summed per index,
    in each task first: one exchange, and no join.
    """
    require_same(t.shape, u.shape, "shapes differ")
    negated = u.frame.withColumn("value", -F.col("value"))
    apart = t.frame.unionByName(negated).groupBy(*t.index_cols).agg(F.sum("value").alias("value"))
    return none_of(apart, ~is_close(F.col("value"), 0.0, tol))
