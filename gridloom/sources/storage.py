"""Tensors and models kept as Parquet folders."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridloom.model import CPModel
from gridloom.tensor import TensorFrame


def write_tensor(tensor: TensorFrame, path: str, mode: str = "errorifexists") -> None:
    spark = tensor.spark
    tensor.frame.write.mode(mode).parquet(f"{path}/cells")
    spark.createDataFrame(
        [(list(tensor.shape), tensor.unique)], "shape array<bigint>, is_unique boolean"
    ).write.mode(mode).parquet(f"{path}/meta")


def read_tensor(spark: SparkSession, path: str) -> TensorFrame:
    meta = spark.read.schema("shape array<bigint>, is_unique boolean").parquet(f"{path}/meta").first()
    fields = ", ".join(f"i{m} bigint" for m in range(len(meta.shape)))
    cells = spark.read.schema(f"{fields}, value double").parquet(f"{path}/cells")
    return TensorFrame(cells, tuple(meta.shape), unique=meta.is_unique, stored=True)


def write_model(model: CPModel, path: str, mode: str = "errorifexists") -> None:
    spark = model.factors[0].sparkSession
    model.table().write.mode(mode).partitionBy("mode").parquet(f"{path}/factors")
    spark.createDataFrame(
        [(list(model.shape), list(model.lam))], "shape array<bigint>, lam array<double>"
    ).write.mode(mode).parquet(f"{path}/meta")


def read_model(spark: SparkSession, path: str) -> CPModel:
    meta = spark.read.schema("shape array<bigint>, lam array<double>").parquet(f"{path}/meta").first()
    table = spark.read.schema("idx bigint, vec array<double>, mode int").parquet(f"{path}/factors")
    return CPModel.from_table(table, meta.lam, tuple(meta.shape))
