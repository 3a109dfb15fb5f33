"""Exact top-k and numbering inside groups, without sorting a whole group in one task.

Small groups (a known extent up to ``WINDOW_ROWS``) use a plain window.  Larger
ones are first counted into buckets; only counts are put in order, and a window
never sees more than one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.materialize import stage

WINDOW_ROWS = 1 << 18
BUCKET_ROWS = 1 << 16
# Buckets per e-fold of the sort key, and parts each of those is split into again.
COARSE = 1024
FINE = 1 << 16
ZERO_WEIGHT = 1 << 40


def _cut_bucket(counts: DataFrame, groups: Sequence[str], bucket: str, k: str) -> DataFrame:
    """Per group the bucket in which the k-th row lies, and what is left to take there."""
    run = Window.partitionBy(*groups).orderBy(bucket)
    so_far = F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        counts.withColumn("run", so_far)
        .where((F.col("run") >= F.col(k)) & (F.col("run") - F.col("n") < F.col(k)))
        .select(*groups, F.col(bucket).alias("at"), (F.col(k) - F.col("run") + F.col("n")).alias("left"))
    )


def take_best(frame: DataFrame, groups: Sequence[str], max_group: int) -> DataFrame:
    """The ``k`` best rows of each group.

    ``frame`` has the group columns, ``idx``, ``mag`` (smaller is better, a double,
    null for rows that come last) and ``k``, the same for all rows of a group.
    Ties go to the lower ``idx``.  The result is exact on both ways; the second one
    writes the scored rows out first.
    """
    order = [F.col("mag").asc_nulls_last(), F.col("idx").asc()]
    ranked = Window.partitionBy(*groups).orderBy(*order)
    if max_group <= WINDOW_ROWS:
        return frame.withColumn("rank", F.row_number().over(ranked)).where("rank <= k").drop("rank")

    # Counting and taking are separate passes and must see the very same numbers.
    frame = stage(frame, "scores")
    last = F.lit(ZERO_WEIGHT).cast("bigint")
    scaled = F.greatest(F.least(F.col("mag") * COARSE, F.lit(1e9)), F.lit(-1e9))
    coarse = F.floor(scaled)
    fine = F.floor((scaled - coarse) * FINE)
    rows = frame.withColumn("coarse", F.coalesce(coarse, last)).withColumn(
        "fine", F.coalesce(fine, F.floor(F.col("idx") / BUCKET_ROWS))
    )
    counts = rows.groupBy(*groups, "coarse", "k").agg(F.count(F.lit(1)).alias("n"))
    first = _cut_bucket(counts, groups, "coarse", "k").select(
        *groups, F.col("at").alias("at_coarse"), F.col("left").alias("k2")
    )
    # One row per group: as few as the groups are.
    rows = rows.join(F.broadcast(first), list(groups), "left")
    edge = rows.where("coarse = at_coarse")
    counts = edge.groupBy(*groups, "fine", "k2").agg(F.count(F.lit(1)).alias("n"))
    second = _cut_bucket(counts, groups, "fine", "k2").select(
        *groups, F.col("at").alias("at_fine"), F.col("left").alias("k3")
    )
    rows = rows.join(F.broadcast(second), list(groups), "left")
    before = F.expr(
        "at_coarse is null or coarse < at_coarse or (coarse = at_coarse and fine < at_fine)"
    )
    cols = frame.columns
    sure = rows.where(before).select(*cols)
    tied = (
        rows.where("coarse = at_coarse and fine = at_fine")
        .withColumn("rank", F.row_number().over(ranked))
        .where("rank <= k3")
        .select(*cols)
    )
    return sure.unionByName(tied)


def number_rows(frame: DataFrame, groups: Sequence[str], idx: str, extent: int) -> DataFrame:
    """Adds ``position``: 0, 1, ... by ascending ``idx`` (unique in its group)."""
    if extent <= WINDOW_ROWS:
        w = Window.partitionBy(*groups).orderBy(idx)
        return frame.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))
    rows = frame.withColumn("bucket", F.floor(F.col(idx) / BUCKET_ROWS))
    counts = rows.groupBy(*groups, "bucket").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    starts = counts.withColumn("start", F.sum("n").over(run) - F.col("n")).drop("n")
    inside = Window.partitionBy(*groups, "bucket").orderBy(idx)
    return (
        rows.withColumn("within", F.row_number().over(inside) - 1)
        .join(starts, [*groups, "bucket"])
        .withColumn("position", (F.col("start") + F.col("within")).cast("bigint"))
        .drop("bucket", "within", "start")
    )
