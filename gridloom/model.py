"""The CP model: one factor table per mode and the component weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.tensor import Shape


class CPModel:
    """Factor tables ``(idx bigint, vec array<double>)``, complete for 0..len-1.

    Factors stay distributed; only the ``rank`` component weights are on the driver.
    """

    def __init__(self, factors: Sequence[DataFrame], lam: Sequence[float], shape: Shape):
        if len(factors) != len(shape):
            raise ValueError(f"{len(factors)} factors for shape {shape}")
        self.factors = list(factors)
        self.lam = tuple(float(v) for v in lam)
        self.shape = tuple(int(n) for n in shape)

    @property
    def rank(self) -> int:
        return len(self.lam)

    @property
    def n_modes(self) -> int:
        return len(self.shape)

    def flat(self, m: int) -> DataFrame:
        """Factor of mode ``m`` as ``(idx, f0, f1, ...)``."""
        from gridloom.operators.factors import unpack

        return unpack(self.factors[m], self.rank)

    def table(self) -> DataFrame:
        """All factors as ``(mode, idx, vec)``."""
        tagged = [
            f.select(F.lit(m).cast("int").alias("mode"), "idx", "vec")
            for m, f in enumerate(self.factors)
        ]
        return reduce(DataFrame.unionByName, tagged)

    @staticmethod
    def from_table(table: DataFrame, lam: Sequence[float], shape: Shape) -> CPModel:
        factors = [
            table.where(F.col("mode") == m).select("idx", "vec") for m in range(len(shape))
        ]
        return CPModel(factors, lam, shape)


def make_model(
    factors: Sequence[DataFrame], shape: Shape, rank: int, lam: Sequence[float] | None = None
) -> CPModel:
    """Model from factor tables; the weights are 1 unless given."""
    if lam is not None and len(lam) != rank:
        raise ValueError(f"{len(lam)} weights for rank {rank}")
    return CPModel(factors, [1.0] * rank if lam is None else lam, shape)
