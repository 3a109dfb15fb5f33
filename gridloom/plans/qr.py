"""Triangular factor and pseudo-inverse of tall matrices by a tree of small QR steps.

Every partition reduces its rows to a triangle of ``rank`` rows; triangles are merged ``FAN_IN``
at a time, each merge a task of its own, until few enough are left for the driver.  Nothing is
squared on the way, so singular values keep the precision that the Gram matrix would halve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.factors import pack, unpack
from gridloom.plans.cp import constants
from gridloom.plans.materialize import Scratch

#: Triangles that one merge takes.
FAN_IN = 64
#: Rows of a partition that are reduced together.
ROWS = 1 << 14

_TRIANGLES = "id bigint, triangle binary"


def _reduced(stack: np.ndarray) -> np.ndarray:
    """The triangle of a matrix, with no more rows than columns."""
    return np.linalg.qr(stack, mode="r")


def _matrix(vec: pa.Array, rank: int) -> np.ndarray:
    """Rows of a column of arrays; all have ``rank`` numbers."""
    if pc.any(pc.not_equal(pc.list_value_length(vec), rank)).as_py():
        raise ValueError(f"every row needs {rank} numbers")
    rows = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, rank)
    return rows


def _leaves(rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = np.zeros((0, rank))
        for batch in batches:
            rows = _matrix(batch.column(0), rank)
            for at in range(0, len(rows), ROWS):
                triangle = _reduced(np.concatenate([triangle, rows[at : at + ROWS]]))
        if len(triangle):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([triangle.tobytes()], pa.binary())], names=["id", "triangle"]
            )

    return run


def _merged(rank: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # the same result whatever comes first
        parts = [np.frombuffer(b.as_py()).reshape(-1, rank) for b in table.column("triangle")]
        node = table.column("node")[0].as_py()
        return pa.table({"id": [node], "triangle": pa.array([_reduced(np.concatenate(parts)).tobytes()], pa.binary())})

    return run


def triangle(factor: DataFrame, rank: int) -> np.ndarray:
    """R of the QR decomposition of rows ``vec``, up to the signs of its rows; fewer than ``rank``
    rows if the matrix has fewer."""
    with Scratch(factor.sparkSession, "qr") as scratch:
        level = scratch.stage(factor.select("vec").mapInArrow(_leaves(rank), _TRIANGLES), "leaves")
        while level.count() > FAN_IN:
            node = F.expr(f"id div {FAN_IN}L").alias("node")
            merged = level.select("id", "triangle", node).groupBy("node").applyInArrow(_merged(rank), _TRIANGLES)
            level = scratch.stage(merged, "merged")
        found = sorted((r.id, bytes(r.triangle)) for r in level.collect())
    stack = [np.frombuffer(b).reshape(-1, rank) for _, b in found]
    return _reduced(np.concatenate([np.zeros((0, rank)), *stack]))


def _times(factor: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Rows ``(idx, vec)`` times a small matrix."""
    rank, width = matrix.shape
    cols = [constants(matrix[:, c]) for c in range(width)]
    sums = [" + ".join(f"m{r} * get({cols[c]}, {r})" for r in range(rank)) + f" as a{c}" for c in range(width)]
    return pack(unpack(factor, rank, "m").selectExpr("idx", *sums), width, "a").select("idx", "vec")


def pseudo_inverse(factor: DataFrame, rank: int, rcond: float | None = None) -> DataFrame:
    """Pseudo-inverse of a tall matrix given by rows ``(idx, vec)``, as its columns ``(idx, vec)``.

    With X = Q R and R = U S V', the rows of X V / S are those of an almost orthonormal basis;
    the triangle T of that basis says by how much it fails, and the result is
    ``(X V / S) inv(T) inv(T)' inv(S) V'``.  Singular values of at most ``rcond`` (the precision
    of doubles times ``rank`` unless given) of the largest count as 0.  Two passes over the rows
    for the triangles, none of them shuffled; rank-by-rank matrices reach the driver.
    """
    first = triangle(factor, rank)
    _, s, vt = np.linalg.svd(first, full_matrices=False)
    least = rcond if rcond is not None else rank * np.finfo(float).eps
    kept = s > least * (s[0] if len(s) else 0.0)
    if not kept.any():
        zeros = F.array(*[F.lit(0.0)] * rank)
        return factor.select("idx", zeros.alias("vec"))
    scaled = vt[kept].T / s[kept]
    basis = _times(factor, scaled)
    inverse = np.linalg.inv(triangle(basis, int(kept.sum())))
    return _times(basis, inverse @ inverse.T @ scaled.T)
