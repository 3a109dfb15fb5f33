"""Weighted sampling of slices and the sub-tensors and sub-models it selects.

A slice of weight ``w`` gets the score ``u ** (1 / w)`` with its own uniform
number ``u``; the ``k`` largest scores are a weighted sample without replacement.
``ln(u) / w`` has the same order and does not underflow, and a slice of weight 0
comes after all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hash_uniform
from gridloom.model import CPModel
from gridloom.operators.ranking import number_rows, take_best
from gridloom.plans.joins import fits_broadcast, heavy_keys, salted_join
from gridloom.tensor import TensorFrame

# A sample up to this size is taken with a heap per task, whose contents meet in one
# task; larger ones are ranked by window or by buckets.
HEAP_ROWS = 1_000


def _magnitude(seed: int, rep, mode):
    """Logarithm of minus the score: smaller is better, null for weight 0."""
    u = hash_uniform(seed, rep, mode, F.col("idx").cast("string"))
    return F.log(-F.log(u)) - F.log(F.when(F.col("w") > 0, F.col("w")))


def weighted_sample(
    weights: DataFrame, k: int, seed: int = 0, mode: int = 0, extent: int | None = None, rep: int = 0
) -> DataFrame:
    """Indexes of ``k`` sampled slices from ``(idx, w)``, as ``(idx)``.

    ``extent`` is the number of slices when known; it only picks the plan.
    """
    scored = weights.select(
        "idx",
        _magnitude(seed, F.lit(str(rep)), F.lit(str(mode))).alias("mag"),
    )
    if k <= HEAP_ROWS:
        order = [F.col("mag").asc_nulls_last(), F.col("idx")]
        return scored.orderBy(*order).limit(k).select("idx")
    scored = scored.withColumn("mode", F.lit(mode)).withColumn("k", F.lit(k).cast("bigint"))
    return take_best(scored, ["mode"], extent if extent is not None else 1 << 62).select("idx")


def relabel(sample: DataFrame, groups: Sequence[str] = ("mode",), extent: int = 1 << 62) -> DataFrame:
    """Sampled indexes numbered 0, 1, ... ascending: ``(groups.., old_idx, new_idx)``."""
    return number_rows(sample, groups, "idx", extent).select(
        *groups, F.col("idx").alias("old_idx"), F.col("position").alias("new_idx")
    )


def sample_modes(
    weights: DataFrame, sizes: Sequence[int], extents: Sequence[int], seed: int = 0, reps: int = 1, first_rep: int = 0
) -> DataFrame:
    """Independent samples of every mode, for all repetitions in one job:
    ``(rep, mode, old_idx, new_idx)`` from weights ``(mode, idx, w)``."""
    k = F.element_at(F.array(*[F.lit(int(n)).cast("bigint") for n in sizes]), F.col("mode") + 1)
    wanted = weights.select(
        F.explode(F.sequence(F.lit(first_rep), F.lit(first_rep + reps - 1))).alias("rep"),
        "mode", "idx", "w",
    )
    scored = wanted.select(
        "rep", "mode", "idx",
        _magnitude(seed, F.col("rep").cast("string"), F.col("mode").cast("string")).alias("mag"),
        k.alias("k"),
    )
    widest = max(extents)
    best = take_best(scored, ["rep", "mode"], widest).select("rep", "mode", "idx")
    return relabel(best, ["rep", "mode"], widest)


def sample_subtensor(
    tensor: TensorFrame, maps: DataFrame, sizes: Sequence[int], reps: int = 1, modes: Sequence[int] | None = None
) -> DataFrame:
    """Cells whose indexes are all sampled, relabelled: ``(rep, i0.., value)``.

    ``maps`` is ``(rep, mode, old_idx, new_idx)``; ``sizes`` are the sample sizes,
    which bound each map.  Modes not listed keep their indexes.  The smallest
    share of a mode is joined first, so that later joins see fewer cells.
    """
    modes = list(range(tensor.n_modes)) if modes is None else list(modes)
    shape = tensor.known_shape
    if shape is not None:
        modes.sort(key=lambda m: sizes[m] / max(shape[m], 1))
    frame = tensor.frame
    for step, m in enumerate(modes):
        col = tensor.index_cols[m]
        part = maps.where(F.col("mode") == m).select("rep", F.col("old_idx").alias(col), F.col("new_idx").alias("n"))
        # Every repetition's label of an index on one row keeps the join keyed by
        # the index alone; at most ``reps`` entries, so a bounded group.
        by_index = part.groupBy(col).agg(
            F.map_from_entries(F.collect_list(F.struct("rep", "n"))).alias(f"n{m}")
        )
        if fits_broadcast(tensor.spark, min(sizes[m] * reps, shape[m] if shape else sizes[m] * reps), 32 + 16 * reps):
            frame = frame.join(F.broadcast(by_index), col)
        else:
            frame = salted_join(frame, by_index, col, heavy=heavy_keys(tensor.frame, col))
        if step == 0:
            frame = frame.select("*", F.explode(F.map_keys(f"n{m}")).alias("rep"))
        label = F.try_element_at(f"n{m}", F.col("rep"))
        frame = frame.withColumn(col, label).where(F.col(col).isNotNull()).drop(f"n{m}")
    if not modes:
        frame = frame.select(F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), "*")
    return frame.select("rep", *tensor.index_cols, "value")


def sample_model(model: CPModel, maps: DataFrame) -> DataFrame:
    """Factor rows at the sampled indexes, relabelled: ``(rep, mode, idx, vec)``."""
    table = model.table().withColumnRenamed("idx", "old_idx")
    return maps.join(table, ["mode", "old_idx"]).select(
        "rep", "mode", F.col("new_idx").alias("idx"), "vec"
    )


def head_model(model: CPModel, lengths: Sequence[int]) -> CPModel:
    """The first rows of every factor."""
    factors = [f.where(F.col("idx") < n) for f, n in zip(model.factors, lengths, strict=True)]
    shape = [min(n, have) for n, have in zip(lengths, model.shape, strict=True)]
    return CPModel(factors, model.lam, tuple(shape))


def sort_by_mode(tensor: TensorFrame, m: int) -> DataFrame:
    """Cells in order of one index, the others breaking ties."""
    rest = [c for c in tensor.index_cols if c != tensor.index_cols[m]]
    return tensor.frame.orderBy(tensor.index_cols[m], *rest)
