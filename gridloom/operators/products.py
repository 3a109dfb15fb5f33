"""Joins of tensors: contractions, dot products, element-wise operations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.joins import fits_broadcast, keyed_join, salted_join
from gridloom.tensor import TensorFrame, derive_shape, mode_col, require_same, without

BinaryOp = Callable[[Column, Column], Column]

# A right-hand side with at most this many cells per contracted index is packed
# into one row per index.
PACK_WIDTH = 64
# Broadcasting a side saves the shuffle of the other one. When every cell may meet more
# cells than this, the pairs outweigh that shuffle by far, and are shared out instead.
MEETINGS = 256


def _side(tensor: TensorFrame, m: int, prefix: str, value: str) -> tuple[DataFrame, list[str]]:
    """Contracted index as ``k``, the other indexes under ``prefix``."""
    rest = [k for k in range(tensor.n_modes) if k != m]
    names = [f"{prefix}{k}" for k in range(len(rest))]
    frame = tensor.frame.select(
        tensor.index(m).alias("k"),
        *[tensor.index(k).alias(n) for k, n in zip(rest, names, strict=True)],
        F.col("value").alias(value),
    )
    return frame, names


def mode_multiply(t: TensorFrame, m: int, u: TensorFrame, n: int) -> TensorFrame:
    """Contraction of mode ``m`` of ``t`` with mode ``n`` of ``u``.

    Result modes are those of ``t`` without ``m``, then those of ``u`` without
    ``n``; a result cell exists where at least one pair of stored cells met.

    Plans, by what is known of the sizes:

    * ``u`` is narrow (at most ``PACK_WIDTH`` cells per contracted index): its
      rows are packed into one array per index, so each cell of ``t`` meets one
      row, and the array positions are summed as columns. The joined rows are as
      many as the cells of ``t``, not a multiple of them.
    * either side has a proven bound that fits a broadcast, and at most ``MEETINGS``
      cells per contracted index: broadcast join.
    * otherwise a salted shuffle join; sides that are not stored are stored first. A
      pair is formed only for a product that the result needs: for one contracted
      index all pairs are different cells.
    """
    require_same((t.shape[m],), (u.shape[n],), "contracted extents differ")
    shape = derive_shape(lambda a, b: without(a, m) + without(b, n), t, u)
    names = [mode_col(k) for k in range(t.n_modes + u.n_modes - 2)]
    spark = t.spark
    width = prod(without(u.known_shape, n)) if u.known_shape and u.n_modes > 1 else None
    packs = width is not None and 1 < width <= PACK_WIDTH and t.n_modes > 1
    if packs:
        small = fits_broadcast(spark, u.known_shape[n], 8 * (width + 1))
    else:
        small = _can_broadcast(u, n) or _can_broadcast(t, m)
    if not small:
        # The salted join reads its sides more than once, to find the heavy keys.
        t, u = t.store(), u.store()
    left, a = _side(t, m, "a", "x")
    right, b = _side(u, n, "b", "y")
    if packs:
        cells = _packed(left, a, u, n, width)
    else:
        cells = (
            _pairs(left, right, t, m, u, n)
            .groupBy(*a, *b)
            .agg(F.sum(F.col("x") * F.col("y")).alias("value"))
        )
    cells = cells.select(
        *[F.col(c).alias(name) for c, name in zip([*a, *b], names, strict=True)], "value"
    )
    return TensorFrame(cells, shape, unique=True)


def _can_broadcast(side: TensorFrame, mode: int) -> bool:
    """Proven small, and with few cells per contracted index."""
    if not fits_broadcast(side.spark, side.max_rows(), 8 * (side.n_modes + 1)):
        return False
    return prod(without(side.known_shape, mode)) <= MEETINGS


def _pairs(
    left: DataFrame, right: DataFrame, t: TensorFrame, m: int, u: TensorFrame, n: int
) -> DataFrame:
    if _can_broadcast(u, n):
        return left.join(F.broadcast(right), "k")
    if _can_broadcast(t, m):
        return right.join(F.broadcast(left), "k")
    return salted_join(left, right, "k", right_unique=u.unique and u.n_modes == 1)


def _packed(left: DataFrame, a: list[str], u: TensorFrame, n: int, width: int) -> DataFrame:
    rest = [k for k in range(u.n_modes) if k != n]
    extents = [u.known_shape[k] for k in rest]
    steps = [prod(extents[k + 1 :]) for k in range(len(extents))]
    slot = sum(
        (u.index(k) * F.lit(step) for k, step in zip(rest, steps, strict=True)), F.lit(0).cast("bigint")
    )
    packed = (
        u.frame.select(u.index(n).alias("k"), slot.alias("s"), "value")
        .groupBy("k")
        .agg(*[F.sum(F.when(F.col("s") == j, F.col("value"))).alias(f"y{j}") for j in range(width)])
    )
    met = keyed_join(left, packed, "k", u.known_shape[n], 8 * (width + 1))
    sums = met.groupBy(*a).agg(
        *[F.sum(F.col("x") * F.col(f"y{j}")).alias(f"v{j}") for j in range(width)]
    )
    coords = [
        F.expr(f"(s div {step}L) % {extent}L").alias(f"b{k}")
        for k, (step, extent) in enumerate(zip(steps, extents, strict=True))
    ]
    # Nulls mark cells no pair reached.
    return (
        sums.select(*a, F.posexplode(F.array(*[f"v{j}" for j in range(width)])).alias("s", "value"))
        .where("value is not null")
        .select(*a, *coords, "value")
    )


def mode_multiply_vec(t: TensorFrame, m: int, v: TensorFrame) -> TensorFrame:
    """Product with a vector over mode ``m``, which disappears. Absent vector cells
    count as 0 and still leave their group in the result."""
    if v.n_modes != 1:
        raise ValueError("expected a vector")
    require_same((t.shape[m],), v.shape, "extents differ")
    length = v.known_shape[0] if v.known_shape else None
    if not fits_broadcast(t.spark, length, 16):
        t = t.store()
    left, a = _side(t, m, "a", "x")
    right = v.frame.select(F.col("i0").alias("k"), F.col("value").alias("y"))
    if not v.unique:
        right = right.groupBy("k").agg(F.sum("y").alias("y"))
    met = keyed_join(left, right, "k", length, 16, "left")
    cells = met.groupBy(*a).agg(
        F.sum(F.col("x") * F.coalesce(F.col("y"), F.lit(0.0))).alias("value")
    )
    cells = cells.select(*[F.col(c).alias(mode_col(k)) for k, c in enumerate(a)], "value")
    return TensorFrame(cells, derive_shape(lambda s: without(s, m), t), unique=True)


def matmul(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    if a.n_modes != 2 or b.n_modes != 2:
        raise ValueError("expected matrices")
    return mode_multiply(a, 1, b, 0)


def dot(u: TensorFrame, v: TensorFrame) -> DataFrame:
    """One row with the dot product of two vectors; 0.0 when no index is shared."""
    return multi_dot(u, v)


def multi_dot(*vectors: TensorFrame) -> DataFrame:
    """One row with the sum over indexes of the product of all vectors, over the
    indexes stored in every one of them; no vectors give 0.0.

    The vectors lie over each other, told apart by their number, and are summed per index and
    vector before they move: one exchange, however many there are.  An index that a vector
    holds more than once counts with the sum of its values.
    """
    if not vectors:
        from gridloom.session import active_session

        return active_session().range(1).select(F.lit(0.0).alias("value"))
    if any(v.n_modes != 1 for v in vectors):
        raise ValueError("expected vectors")
    for v in vectors[1:]:
        require_same(vectors[0].shape, v.shape, "lengths differ")
    tagged = [v.frame.withColumn("of", F.lit(k)) for k, v in enumerate(vectors)]
    sums = [F.sum(F.when(F.col("of") == k, F.col("value"))).alias(f"v{k}") for k in range(len(vectors))]
    met = reduce(DataFrame.unionByName, tagged).groupBy("i0").agg(*sums)
    # A sum is null where a vector has no cell, and so is the product.
    product = reduce(lambda x, y: x * y, [F.col(f"v{k}") for k in range(len(vectors))])
    return met.agg(F.coalesce(F.sum(product), F.lit(0.0)).alias("value"))


def _matched(t: TensorFrame, u: TensorFrame, how: str) -> DataFrame:
    require_same(t.shape, u.shape, "shapes differ")
    left = t.frame.withColumnRenamed("value", "x")
    right = u.frame.withColumnRenamed("value", "y")
    return left.join(right, t.index_cols, how)


def elementwise(t: TensorFrame, u: TensorFrame, op: BinaryOp) -> TensorFrame:
    """``op`` on the cells stored in both tensors."""
    met = _matched(t, u, "inner")
    cells = met.select(*t.index_cols, op(F.col("x"), F.col("y")).cast("double").alias("value"))
    return TensorFrame(cells, t.shape, t.unique and u.unique)


def elementwise_full(t: TensorFrame, u: TensorFrame, op: BinaryOp) -> TensorFrame:
    """``op`` on the cells stored in either tensor, absent ones taken as 0.0."""
    met = _matched(t, u, "full")
    x, y = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("x", "y"))
    cells = met.select(*t.index_cols, op(x, y).cast("double").alias("value"))
    return TensorFrame(cells, t.shape, t.unique and u.unique)


def subtract(t: TensorFrame, u: TensorFrame) -> TensorFrame:
    """Difference; cells that come out 0 stay stored."""
    return elementwise_full(t, u, lambda x, y: x - y)


def hadamard(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return elementwise(a, b, lambda x, y: x * y)
