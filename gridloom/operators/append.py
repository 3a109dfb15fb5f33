"""Growing a tensor or a factor along one mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import CPModel
from gridloom.operators.modes import shift_mode
from gridloom.tensor import TensorFrame, derive_shape, require_same, without


def mode_append(tensor: TensorFrame, other: TensorFrame, n: int = -1) -> TensorFrame:
    """``other`` placed after ``tensor`` on mode ``n``: a shift and a bag union."""
    n = n % tensor.n_modes
    length = tensor.shape[n]
    require_same(without(tensor.shape, n), without(other.shape, n), "extents differ")
    shape = derive_shape(lambda s, o: s[:n] + (s[n] + o[n],) + s[n + 1 :], tensor, other)
    moved = shift_mode(other, n, length)
    return TensorFrame(
        tensor.frame.unionByName(moved.frame),
        shape,
        tensor.unique and other.unique,
        tensor.stored and other.stored,
    )


def append_rows(model: CPModel, mode: int, rows: DataFrame, count: int) -> CPModel:
    """``count`` new factor rows ``(idx, vec)``, numbered from 0, after those of ``mode``."""
    start = model.shape[mode]
    moved = rows.select((F.col("idx") + F.lit(start).cast("bigint")).alias("idx"), "vec")
    factors = list(model.factors)
    factors[mode] = factors[mode].select("idx", "vec").unionByName(moved)
    shape = model.shape[:mode] + (start + count,) + model.shape[mode + 1 :]
    return CPModel(factors, model.lam, shape)
