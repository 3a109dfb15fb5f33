"""Tensors made from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.plans.joins import fits_broadcast
from gridloom.plans.materialize import stage
from gridloom.sources.construct import from_arrays, from_coo
from gridloom.tensor import TensorFrame

# Labels that one task numbers.
LABELS_A_RANGE = 1 << 20

# Fixed value: day 0 of the event tensor.
FIRST_DAY = "2024-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_numbers(df: DataFrame, col: str, name: str) -> DataFrame:
    """Labels in alphabetical order with their number, ``(col, name)``, however many; a null
    label fails the job.

    The distinct labels are written once and, if they are many, once more by ranges; each range
    is numbered by itself and shifted by the labels of the ranges before it, of which only the
    counts reach the driver.  The result is broadcast up to a checked size.
    """
    missing = F.raise_error(F.lit(f"null label in {col}")).cast(df.schema[col].dataType)
    labels = stage(df.select(F.coalesce(F.col(col), missing).alias(col)).distinct(), "labels")
    told = labels.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length(F.col(col).cast("string"))).alias("octets")).first()
    parts = -(-told.n // LABELS_A_RANGE)
    by = F.lit(0)
    shift = F.lit(0)
    if parts > 1:
        ranged = labels.repartitionByRange(parts, col).withColumn("part", F.spark_partition_id())
        labels = stage(ranged, "labels")
        sizes = {r.part: r["count"] for r in labels.groupBy("part").count().collect()}
        starts, so_far = [], 0
        for part in range(max(sizes) + 1):
            starts.append(F.lit(so_far))
            so_far += sizes.get(part, 0)
        by, shift = F.col("part"), F.get(F.array(*starts), F.col("part"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(col)) - 1 + shift
    numbers = labels.select(col, place.cast("bigint").alias(name))
    fits = fits_broadcast(df.sparkSession, told.n, 16 + 2 * (told.octets or 0))
    return F.broadcast(numbers) if fits else numbers


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ``(user, kind, day, cents)``."""
    events = read(spark, sf_dir, "events")
    kinds = label_numbers(events, "event_type", "kind")
    return events.join(kinds, "event_type").select(
        F.col("user_id").alias("user"),
        "kind",
        F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date")).cast("bigint").alias("day"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def event_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    row = (
        read(spark, sf_dir, "events")
        .agg(
            F.max("user_id") + 1,
            F.count_distinct("event_type"),
            F.datediff(F.to_date(F.max("ts")), F.lit(FIRST_DAY).cast("date")) + 1,
        )
        .first()
    )
    return tuple(int(v) for v in row)


def events_tensor(spark: SparkSession, sf_dir: str, shaped: bool = True) -> TensorFrame:
    """user x event type x day, holding the summed value. Cents are summed as whole
    numbers, so the cells do not depend on the order of summation."""
    cells = (
        event_rows(spark, sf_dir)
        .groupBy("user", "kind", "day")
        .agg((F.sum("cents") / F.lit(100.0)).alias("value"))
    )
    frame = cells.selectExpr("user as i0", "kind as i1", "day as i2", "value")
    shape = event_shape(spark, sf_dir) if shaped else (lambda: event_shape(spark, sf_dir))
    return TensorFrame(frame, shape, unique=True)


def event_counts(spark: SparkSession, sf_dir: str, shape=None) -> TensorFrame:
    """user x event type x day, holding the number of events."""
    return from_coo(
        event_rows(spark, sf_dir).withColumn("one", F.lit(1)), ["user", "kind", "day"], "one", shape
    )


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as ``(nation, brand, month, quantity)``."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity",
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m"),
    )
    first = read(spark, sf_dir, "lineitem").agg(
        F.min(F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("first")
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = label_numbers(parts, "p_brand", "brand")
    return (
        lines.join(parts.join(brands, "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_nationkey").cast("bigint").alias("nation"),
            "brand",
            (F.col("m") - first.scalar()).cast("bigint").alias("month"),
            F.col("l_quantity").alias("quantity"),
        )
    )


def sales_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    nations = read(spark, sf_dir, "customer").agg(F.max("c_nationkey") + 1).first()[0]
    brands = read(spark, sf_dir, "part").agg(F.count_distinct("p_brand")).first()[0]
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    months = read(spark, sf_dir, "lineitem").agg(F.max(month) - F.min(month) + 1).first()[0]
    return int(nations), int(brands), int(months)


def sales_tensor(spark: SparkSession, sf_dir: str, shaped: bool = True) -> TensorFrame:
    """nation x brand x month, holding the summed quantity (whole numbers)."""
    shape = sales_shape(spark, sf_dir) if shaped else None
    return from_coo(sales_rows(spark, sf_dir), ["nation", "brand", "month"], "quantity", shape)


def brand_sizes(spark: SparkSession, sf_dir: str, shape=None) -> TensorFrame:
    """brand x part size, holding the number of parts."""
    parts = read(spark, sf_dir, "part").select("p_brand", "p_size")
    brands = label_numbers(parts, "p_brand", "brand")
    rows = parts.join(brands, "p_brand").withColumn("one", F.lit(1))
    return from_coo(rows, ["brand", "p_size"], "one", shape)


def vectors_matrix(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """Embeddings as a matrix in coordinate form."""
    return from_arrays(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def vectors_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as factor rows ``(idx, vec)`` of rank 64."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec")
    )
