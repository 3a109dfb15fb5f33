"""Sparse tensors, CP decomposition and its incremental upkeep as Spark jobs."""

from gridloom.model import CPModel, make_model
from gridloom.tensor import TensorFrame

__all__ = ["CPModel", "TensorFrame", "make_model"]
