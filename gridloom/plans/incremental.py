"""Keeping a CP model current while new slices arrive on one mode.

A step works on weighted samples of what has been seen, joined with the new
slices: each repetition's sample is decomposed, its components are lined up with
the existing ones, rows of the new slices are averaged over the repetitions, and
existing rows take values only where they were zero.  All repetitions run in the
same jobs, as blocks of one table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import CPModel
from gridloom.operators.aggregates import merge_weights, slice_weights
from gridloom.operators.append import append_rows, mode_append
from gridloom.operators.factors import complete, mean_factors, pack
from gridloom.operators.sampling import sample_model, sample_modes, sample_subtensor
from gridloom.plans.cp import fit_blocks
from gridloom.plans.matching import (
    component_similarity,
    match_components,
    rearrange,
    renorm,
    update_zeros,
)
from gridloom.plans.materialize import Scratch, stage
from gridloom.tensor import Shape, TensorFrame, mode_col, require_same, without


@dataclass(frozen=True)
class DecompositionState:
    """Everything seen so far: cells, slice weights ``(mode, idx, w)`` and the model.
    A step makes a new state and leaves the old one as it is."""

    tensor: TensorFrame
    weights: DataFrame
    model: CPModel | None = None


def start_state(tensor: TensorFrame, model: CPModel) -> DecompositionState:
    """State to go on from. The weights, one row per index, are written out: every
    step reads them again, and making them reads all cells."""
    require_same(tensor.shape, model.shape, "model and tensor differ in shape")
    return DecompositionState(tensor, stage(slice_weights(tensor), "weights"), model)


def append_slice(state: DecompositionState, new: TensorFrame, mode: int) -> DecompositionState:
    """Tensor and weights with new slices placed after the others on ``mode``."""
    require_same(without(state.tensor.shape, mode), without(new.shape, mode), "extents differ")
    weights = merge_weights(state.weights, slice_weights(new), mode, state.tensor.shape[mode])
    return replace(state, tensor=mode_append(state.tensor, new, mode), weights=weights)


def step_seed(seed: int, extent: int) -> int:
    """Seed of a step on a tensor that has grown to ``extent`` slices."""
    return seed * 1_000_003 + extent


def sample_sizes(shape: Shape, factor: int) -> Shape:
    return tuple(max(1, n // factor) for n in shape)


def _as_blocks(cells: DataFrame, extents: Shape) -> DataFrame:
    """Repetitions laid side by side: block ``rep`` starts at ``rep * extent``."""
    shifted = [f"rep * {n}L + {mode_col(m)} as {mode_col(m)}" for m, n in enumerate(extents)]
    return cells.selectExpr(*shifted, "value")


def _refit(
    state: DecompositionState, new: TensorFrame, mode: int, sizes: Shape, first_rep: int, reps: int,
    max_iter: int, tol: float, seed: int, fit_seed: int, scratch: Scratch,
) -> tuple[DataFrame, DataFrame]:
    """Decompose the samples and line them up with the model.

    Gives the fitted rows ``(rep, mode, idx, vec)``, scaled like the model's, and
    the index maps ``(rep, mode, old_idx, new_idx)``; ``rep`` counts from 0.
    """
    model, shape, rank = state.model, state.tensor.shape, state.model.rank
    batch = new.shape[mode]
    drawn = sample_modes(state.weights, sizes, shape, seed, reps, first_rep)
    maps = scratch.stage(drawn.withColumn("rep", F.col("rep") - F.lit(first_rep)), "maps")

    old_cells = sample_subtensor(state.tensor, maps, sizes, reps)
    others = [m for m in range(len(shape)) if m != mode]
    new_cells = sample_subtensor(new, maps, sizes, reps, others).withColumn(
        mode_col(mode), F.col(mode_col(mode)) + F.lit(sizes[mode]).cast("bigint")
    )
    extents = sizes[:mode] + (sizes[mode] + batch,) + sizes[mode + 1 :]
    cells = scratch.stage(_as_blocks(old_cells.unionByName(new_cells), extents), "sample")
    fit = fit_blocks(
        cells, extents, rank, range(reps), max_iter, tol, fit_seed, folder=f"{scratch.folder}/fit-{first_rep}"
    )

    fitted: DataFrame | None = None
    for m, rows in enumerate(fit.factors):
        part = pack(rows.withColumnRenamed("block", "rep"), rank).select(
            "rep", F.lit(m).alias("mode"), "idx", "vec"
        )
        fitted = part if fitted is None else fitted.unionByName(part)
    fitted = scratch.stage(fitted, "fitted")
    reference = scratch.stage(sample_model(model, maps), "reference")

    first = others[0]
    similarity = component_similarity(
        fitted.where(F.col("mode") == first).drop("mode"),
        reference.where(F.col("mode") == first).drop("mode"),
        rank,
    )
    matched = rearrange(fitted, match_components(similarity, rank), rank)
    return scratch.stage(renorm(matched, reference, rank), "aligned"), maps


def _apply(
    model: CPModel, aligned: DataFrame, maps: DataFrame
) -> CPModel:
    """Fitted rows of existing indexes put into the zero entries of the model."""
    rows = aligned.withColumnRenamed("idx", "new_idx").join(maps, ["rep", "mode", "new_idx"])
    return update_zeros(model, rows.select("rep", "mode", F.col("old_idx").alias("idx"), "vec"))


def incremental_step(
    state: DecompositionState, new: TensorFrame, mode: int, factor: int = 2, reps: int = 1,
    max_iter: int = 500, tol: float = 1e-4, seed: int = 0, fit_seed: int = 6, sequential: bool = False,
    scratch: Scratch | None = None,
) -> DecompositionState:
    """One batch of new slices on ``mode``.

    Samples take ``extent // factor`` slices of every mode (at least one).  With
    ``sequential`` the repetitions run one after the other and each sees the zero
    entries filled by those before it; otherwise all of them start from the model
    as it was and the first to fill an entry wins.  The component weights of the
    model stay as they are; scale enters through the lengths of existing rows.

    Random numbers depend on ``seed`` and on how far the tensor has grown, so every step
    draws a new sample and a step done again draws the same.

    Tables written on the way are removed at the end.  With a ``scratch`` folder they
    go there, the new model and weights too, and the caller removes it.
    """
    if mode < 0:
        mode += state.tensor.n_modes
    require_same(without(state.tensor.shape, mode), without(new.shape, mode), "extents differ")
    if reps < 1 or factor < 1:
        raise ValueError("reps and factor must be positive")
    rank, batch = state.model.rank, new.shape[mode]
    sizes = sample_sizes(state.tensor.shape, factor)
    seed = step_seed(seed, state.tensor.shape[mode])
    if not new.stored:
        new = TensorFrame(stage(new.frame, "slice"), new.shape, new.unique, stored=True)

    own = Scratch(state.tensor.spark, "step") if scratch is None else scratch
    keep = stage if scratch is None else scratch.stage
    try:
        rounds: Sequence[tuple[int, int]] = [(r, 1) for r in range(reps)] if sequential else [(0, reps)]
        model, fresh = state.model, None
        for first_rep, count in rounds:
            aligned, maps = _refit(
                replace(state, model=model), new, mode, sizes, first_rep, count,
                max_iter, tol, seed, fit_seed, own,
            )
            tail = aligned.where((F.col("mode") == mode) & (F.col("idx") >= sizes[mode])).select(
                (F.col("idx") - F.lit(sizes[mode]).cast("bigint")).alias("idx"), "vec"
            )
            fresh = tail if fresh is None else fresh.unionByName(tail)
            model = _apply(model, aligned, maps)
            if sequential:
                model = CPModel.from_table(own.stage(model.table(), "model"), model.lam, model.shape)
        averaged = complete(mean_factors(fresh, rank, reps), batch, rank)
        model = append_rows(model, mode, averaged, batch)
        table = keep(model.table(), "model")
        grown = append_slice(state, new, mode)
        return DecompositionState(
            grown.tensor, keep(grown.weights, "weights"), CPModel.from_table(table, model.lam, model.shape)
        )
    finally:
        if scratch is None:
            own.drop()
