"""Sparse tensors as coordinate tables.

A tensor is a DataFrame with one ``bigint`` column per mode (``i0``, ``i1``, ...)
and a ``double`` column ``value``; its shape is small metadata kept beside the
table.  Absent cells are zero.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Shape = tuple[int, ...]


def mode_col(m: int) -> str:
    return f"i{m}"


class TensorFrame:
    """A coordinate table plus its shape.

    ``shape`` may be given as a function; it is then worked out on first use,
    so operators that do not need it start no job.  ``unique`` says that no
    coordinate occurs twice, which makes ``prod(shape)`` a proven bound on the
    number of rows.  ``stored`` says the table is read back from storage, so
    reading it again costs a scan and nothing more.
    """

    def __init__(
        self,
        frame: DataFrame,
        shape: Shape | Callable[[], Shape] | None = None,
        unique: bool = False,
        stored: bool = False,
    ):
        self.frame = frame
        self.n_modes = len(frame.columns) - 1
        self.index_cols = [mode_col(m) for m in range(self.n_modes)]
        if frame.columns != [*self.index_cols, "value"]:
            raise ValueError(f"expected columns i0.., value but got {frame.columns}")
        if isinstance(shape, tuple) and len(shape) != self.n_modes:
            raise ValueError(f"shape {shape} does not fit {self.n_modes} modes")
        self._shape = shape
        self.unique = unique
        self.stored = stored

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    @property
    def known_shape(self) -> Shape | None:
        """The shape if it is at hand without running a job."""
        return self._shape if isinstance(self._shape, tuple) else None

    @property
    def shape(self) -> Shape:
        if not isinstance(self._shape, tuple):
            self._shape = tuple(self._shape() if self._shape else self._measure())
        return self._shape

    def _measure(self) -> Shape:
        if not self.n_modes:
            return ()
        row = self.frame.agg(
            *[F.coalesce(F.max(c) + 1, F.lit(0)).alias(c) for c in self.index_cols]
        ).first()
        return tuple(int(v) for v in row)

    def max_rows(self) -> int | None:
        """Proven upper bound on the stored rows, if there is one."""
        if self.unique and self.known_shape is not None:
            return prod(self.known_shape)
        return None

    def index(self, m: int) -> Column:
        return F.col(mode_col(m))

    def persist(self) -> TensorFrame:
        return TensorFrame(self.frame.persist(), self._shape, self.unique, self.stored)

    def store(self) -> TensorFrame:
        """The tensor read back from a table in the shared folder.  For tensors that
        are costly to make and read more than once."""
        from gridloom.plans.materialize import stage

        if self.stored:
            return self
        return TensorFrame(stage(self.frame, "cells"), self._shape, self.unique, stored=True)

    # --- the operator surface as methods -------------------------------------
    def nnz(self) -> int:
        from gridloom.operators import aggregates

        return aggregates.nnz(self).first()[0]

    def norm(self) -> float:
        from gridloom.operators import aggregates

        return aggregates.norm(self).first()[0]

    def forall(self, cond: Callable[[Column], Column]) -> bool:
        from gridloom.operators import modes

        return modes.forall(self, cond).first()[0]

    def mode_append(self, other: TensorFrame, n: int = -1) -> TensorFrame:
        from gridloom.operators import append

        return append.mode_append(self, other, n)

    def mode_multiply(self, m: int, other: TensorFrame, n: int) -> TensorFrame:
        from gridloom.operators import products

        return products.mode_multiply(self, m, other, n)

    def mode_multiply_vec(self, m: int, vector: TensorFrame) -> TensorFrame:
        from gridloom.operators import products

        return products.mode_multiply_vec(self, m, vector)

    def elementwise(self, other: TensorFrame, op) -> TensorFrame:
        from gridloom.operators import products

        return products.elementwise(self, other, op)

    def elementwise_full(self, other: TensorFrame, op) -> TensorFrame:
        from gridloom.operators import products

        return products.elementwise_full(self, other, op)

    def __sub__(self, other: TensorFrame) -> TensorFrame:
        from gridloom.operators import products

        return products.subtract(self, other)


def derive_shape(make: Callable[..., Shape], *tensors: TensorFrame):
    """Shape of a result: a tuple when all inputs know theirs, else put off."""
    if all(t.known_shape is not None for t in tensors):
        return tuple(make(*[t.known_shape for t in tensors]))
    return lambda: tuple(make(*[t.shape for t in tensors]))


def require_same(a: Shape, b: Shape, what: str) -> None:
    """Extent check.  Callers give measured shapes where none were stated."""
    if tuple(a) != tuple(b):
        raise ValueError(f"{what}: {a} against {b}")


def without(shape: Shape, *modes: int) -> Shape:
    return tuple(n for m, n in enumerate(shape) if m not in modes)
