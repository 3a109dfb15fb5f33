"""Row-local work on indexes and values: projections, maps, predicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.tensor import Shape, TensorFrame, derive_shape, mode_col, without


def _named(tensor: TensorFrame, cols: Sequence[Column], shape, unique: bool, value: Column | None = None):
    picked = [c.cast("bigint").alias(mode_col(m)) for m, c in enumerate(cols)]
    value = F.col("value") if value is None else value.cast("double").alias("value")
    return TensorFrame(tensor.frame.select(*picked, value), shape, unique)


def keep_modes(tensor: TensorFrame, *modes: int) -> TensorFrame:
    """Only the listed modes, in their own order; cells that fall together stay apart."""
    kept = [m for m in range(tensor.n_modes) if m in modes]
    shape = derive_shape(lambda s: tuple(s[m] for m in kept), tensor)
    unique = tensor.unique and len(kept) == tensor.n_modes
    return _named(tensor, [tensor.index(m) for m in kept], shape, unique)


def drop_modes(tensor: TensorFrame, *modes: int) -> TensorFrame:
    return keep_modes(tensor, *[m for m in range(tensor.n_modes) if m not in modes])


def append_modes(tensor: TensorFrame, *values: int) -> TensorFrame:
    """Constant modes after the existing ones; each has extent value + 1."""
    cols = [tensor.index(m) for m in range(tensor.n_modes)] + [F.lit(int(v)) for v in values]
    shape = derive_shape(lambda s: s + tuple(int(v) + 1 for v in values), tensor)
    return _named(tensor, cols, shape, tensor.unique)


def with_mode(
    tensor: TensorFrame, m: int, expr: int | Callable[[Column], Column], extent: int | None = None
) -> TensorFrame:
    """Mode ``m`` set to a constant or to a function of its index."""
    new = expr(tensor.index(m)) if callable(expr) else F.lit(int(expr))
    cols = [new if k == m else tensor.index(k) for k in range(tensor.n_modes)]
    shape = (
        None
        if extent is None
        else derive_shape(lambda s: s[:m] + (extent,) + s[m + 1 :], tensor)
    )
    return _named(tensor, cols, shape, False)


def shift_mode(tensor: TensorFrame, m: int, by: int) -> TensorFrame:
    """Mode ``m`` moved by a constant, the extent with it."""
    moved = with_mode(tensor, m, lambda i: i + F.lit(int(by)).cast("bigint"))
    shape = derive_shape(lambda s: s[:m] + (s[m] + by,) + s[m + 1 :], tensor)
    return TensorFrame(moved.frame, shape, tensor.unique)


def map_modes(
    tensor: TensorFrame, f: Callable[[Column, int], Column], shape: Shape | None = None
) -> TensorFrame:
    """``f(index, mode)`` on every mode."""
    return _named(tensor, [f(tensor.index(m), m) for m in range(tensor.n_modes)], shape, False)


def map_entries(
    tensor: TensorFrame,
    value: Callable[[list[Column], Column], Column],
    indexes: Callable[[list[Column], Column], Sequence[Column]] | None = None,
    shape: Shape | None = None,
) -> TensorFrame:
    """New value, and new coordinates if wanted, from each cell."""
    coord = [tensor.index(m) for m in range(tensor.n_modes)]
    new_value = value(coord, F.col("value"))
    if indexes is None:
        return _named(tensor, coord, tensor._shape, tensor.unique, new_value)
    return _named(tensor, indexes(coord, F.col("value")), shape, False, new_value)


def transpose(matrix: TensorFrame) -> TensorFrame:
    if matrix.n_modes != 2:
        raise ValueError("only matrices can be transposed")
    shape = derive_shape(lambda s: (s[1], s[0]), matrix)
    return _named(matrix, [matrix.index(1), matrix.index(0)], shape, matrix.unique)


def forall(tensor: TensorFrame, cond: Callable[[Column], Column]) -> DataFrame:
    """One row: does every stored value meet the condition (true when none is stored).  A task
    ends at its first value that does not."""
    return none_of(tensor.frame, ~cond(F.col("value")))


def none_of(frame: DataFrame, broken: Column) -> DataFrame:
    """One row ``holds``: is there no row for which ``broken`` is true."""
    return frame.where(broken).select(F.lit(1).alias("one")).limit(1).agg((F.count("one") == 0).alias("holds"))


def column(matrix: TensorFrame, c: int) -> TensorFrame:
    """Column ``c`` of a matrix as a vector."""
    picked = TensorFrame(matrix.frame.where(matrix.index(1) == c), matrix._shape, matrix.unique)
    shape = derive_shape(lambda s: without(s, 1), matrix)
    return TensorFrame(keep_modes(picked, 0).frame, shape, matrix.unique)
