"""CP decomposition by alternating least squares, and what a CP model predicts.

One update of a factor is one pass over the cells: every cell meets the rows of
the other factors, all ``rank`` products are summed per index of the updated mode
before the shuffle, and the rank-by-rank solution is applied to the sums in the
same job.  What moves is one row of ``rank`` sums per index and task, however
often an index occurs.  Only rank-by-rank matrices reach the driver.

The error of a finished sweep is one more sum in the first pass of the next one,
so a sweep reads the cells once per mode.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import ratio
from gridloom.model import CPModel
from gridloom.operators.aggregates import square_norm
from gridloom.operators.factors import (
    complete,
    flat_cols,
    gram_sums,
    gramian,
    pack,
    upper_pairs,
)
from gridloom.plans.joins import fits_broadcast, heavy_keys, keyed_join
from gridloom.plans.layout import BlockLayout, co_located
from gridloom.plans.materialize import Scratch, new_folder, put, put_and_measure
from gridloom.sources.construct import index_grid, random_rows
from gridloom.tensor import Shape, TensorFrame, mode_col

# Factor columns one pass may carry; more ranks are done in several passes, which
# keeps the row narrow enough for code generation.
PASS_COLUMNS = 90
# Sums the writing tasks of one update may keep for all blocks together.
MEASURES = 400


def _row_bytes(rank: int) -> int:
    return 8 * (rank + 2)


def _attach(
    frame: DataFrame, m: int, flat: DataFrame, rows: int, ranks: Sequence[int], how: str,
    heavy: dict[int, DataFrame] | None, cells: DataFrame, layout: BlockLayout | None = None,
) -> DataFrame:
    """Cells with the factor row of their index on mode ``m`` as ``f{m}_{r}``.

    ``cells`` is the table before any factor was attached: attaching neither adds nor
    drops rows of an index, so its heavy indexes are looked up there.
    """
    part = flat.selectExpr(f"idx as {mode_col(m)}", *[f"f{r} as f{m}_{r}" for r in ranks])
    if layout is not None and m in layout.modes:
        return layout.attach(frame, m, part, how)
    known = (heavy or {}).get(m)
    if known is None and not fits_broadcast(cells.sparkSession, rows, _row_bytes(len(ranks))):
        known = heavy_keys(cells, mode_col(m))
    return keyed_join(frame, part, mode_col(m), rows, _row_bytes(len(ranks)), how, known)


def _join_order(spark, modes: Sequence[int], extents: Shape, rank: int) -> list[int]:
    """Broadcast factors first, then the others from small to large."""
    return sorted(modes, key=lambda m: (not fits_broadcast(spark, extents[m], _row_bytes(rank)), extents[m]))


def _product(modes: Sequence[int], r: int, outer: bool) -> str:
    """SQL text of the product of the attached factor entries of rank ``r``."""
    return " * ".join(f"coalesce(f{m}_{r}, 0D)" if outer else f"f{m}_{r}" for m in modes)


def _evaluate(modes: Sequence[int], lam: str, rank: int, outer: bool) -> str:
    """SQL text of the model's value of a cell; ``lam`` has a place for the rank."""
    return " + ".join(f"{lam.format(r=r)} * {_product(modes, r, outer)}" for r in range(rank))


def rank_sums(
    cells: DataFrame, flats: dict[int, DataFrame], extents: Shape, n: int, rank: int,
    outer: bool = False, heavy: dict[int, DataFrame] | None = None,
    model_at: str | None = None, layout: BlockLayout | None = None,
) -> DataFrame:
    """``(idx, m0..)``: per index of mode ``n`` the sum over its cells of the value
    times the product of the other factors' rows, for every rank.

    ``model_at``: the model's value of a cell, in which case the factor of ``n`` is
    attached as well and ``sse``, the sum of squared differences, is added.
    ``outer`` keeps cells whose factor row is missing, as zero rows.  With a ``layout``
    the cells are its own, and factors too long to broadcast are sent to their blocks.
    """
    modes = [m for m in range(len(extents)) if m != n]
    attached = modes if model_at is None else [*modes, n]
    per_pass = max(1, PASS_COLUMNS // len(attached))
    if rank > per_pass:
        passes = [list(range(lo, min(lo + per_pass, rank))) for lo in range(0, rank, per_pass)]
    else:
        passes = [list(range(rank))]
    if model_at is not None and len(passes) > 1:
        raise ValueError("the error can be summed along only when one pass holds all ranks")
    results = []
    for ranks in passes:
        frame = cells
        for m in _join_order(cells.sparkSession, attached, extents, len(ranks)):
            frame = _attach(frame, m, flats[m], extents[m], ranks, "left" if outer else "inner", heavy, cells, layout)
        sums = [F.expr(f"sum(value * {_product(modes, r, outer)}) as m{r}") for r in ranks]
        if model_at is not None:
            sums.append(F.expr(f"sum(power({model_at} - value, 2)) as sse"))
        results.append(frame.groupBy(F.expr(f"{mode_col(n)} as idx")).agg(*sums))
    return reduce(lambda a, b: a.join(b, "idx"), results)


def mttkrp(tensor: TensorFrame, model: CPModel, n: int) -> DataFrame:
    """Matricised tensor times Khatri-Rao product for mode ``n``: ``(idx, vec)``
    with a row for every index that has stored cells."""
    if model.n_modes != tensor.n_modes or not 0 <= n < tensor.n_modes:
        raise ValueError("model and mode must fit the tensor")
    flats = {m: model.flat(m) for m in range(model.n_modes) if m != n}
    sums = rank_sums(tensor.frame, flats, model.shape, n, model.rank, outer=True)
    return pack(sums, model.rank, "m").select("idx", "vec")


def _symmetric(values: dict, rank: int) -> np.ndarray:
    g = np.zeros((rank, rank))
    for r, s in upper_pairs(rank):
        g[r, s] = g[s, r] = values[f"g_{r}_{s}"]
    return g


def gram_matrix(factor: DataFrame, rank: int) -> np.ndarray:
    """The rank-by-rank Gram matrix of a factor on the driver."""
    g = np.zeros((rank, rank))
    for row in gramian(factor, rank).collect():
        g[row.r, row.s] = row.value
    return g


def solver(grams: Sequence[np.ndarray]) -> np.ndarray:
    """Pseudo-inverse of the element-wise product of the other factors' Gram matrices."""
    system = reduce(lambda a, b: a * b, grams)
    if not np.all(np.isfinite(system)):
        return np.full_like(system, np.nan)  # shows up in the weights, which are checked
    return np.linalg.pinv(system, hermitian=True)


def constants(numbers: np.ndarray) -> str:
    """SQL text of driver-side numbers as one constant array.

    Generated code refers to a constant array but spells single constants out, so
    this keeps the code of an update the same from sweep to sweep, compiled once.
    """
    texts = [f"{float(x)!r}D" if np.isfinite(x) else "double('NaN')" for x in numbers.ravel()]
    return f"array({', '.join(texts)})"


def _by_block(per_block: dict[int, np.ndarray], col: str, extent: int) -> str:
    """SQL text of number ``{r}`` of the row's block."""
    blocks = max(per_block) + 1
    size = next(iter(per_block.values())).size
    table = np.zeros((blocks, size))
    for b, numbers in per_block.items():
        table[b] = numbers.ravel()
    start = "" if blocks == 1 else f"cast({col} div {extent}L as int) * {size} + "
    return f"get({constants(table)}, {start}{{r}})"


def _times(matrices: dict[int, np.ndarray], rank: int, extent: int = 1) -> list[str]:
    """Row vector ``m0..`` times the rank-by-rank matrix of its block, as ``a0..``.
    The columns of each matrix are kept as arrays of their own, to keep the text short."""
    cols = [_by_block({b: p[:, r] for b, p in matrices.items()}, "idx", extent) for r in range(rank)]
    return [
        " + ".join(f"m{j} * {cols[r].format(r=j)}" for j in range(rank)) + f" as a{r}"
        for r in range(rank)
    ]


@dataclass
class BlockFit:
    """Result of fitting several tensors of one shape side by side."""

    factors: list[DataFrame]  # per mode: (block, idx, f0..), rows only where cells are
    lam: dict[int, np.ndarray]
    errors: dict[int, list[float]] = field(default_factory=dict)


@dataclass
class _Factor:
    raw: DataFrame  # (idx, a0.., [sse]) before scaling, written out
    gram: dict[int, np.ndarray]  # of the scaled columns
    lam: dict[int, np.ndarray]
    flat: DataFrame  # (idx, f0..) scaled


def _block_of(col: str, extent: int) -> Column:
    return F.expr(f"cast({col} div {extent}L as int)")


def _measured(rank: int, with_error: bool) -> list[tuple[str, str]]:
    """Name and SQL text of what is summed over the rows of an update."""
    products = [(f"g_{r}_{s}", f"a{r} * a{s}") for r, s in upper_pairs(rank)]
    return products + ([("sse", "sse")] if with_error else [])


class _Sweeper:
    """The updates of one run. Block ``b`` of a mode holds the indexes
    ``b * extent .. (b + 1) * extent - 1``, so blocks never meet in a join."""

    def __init__(
        self, cells: DataFrame, extents: Shape, rank: int, blocks: Sequence[int], folder: str, lay_out: bool = True
    ):
        self.extents = extents
        self.rank = rank
        self.active = list(blocks)
        self.blocks = len(blocks)
        self.single = list(blocks) == [0]
        self.total = tuple(n * (max(blocks) + 1) for n in extents)
        self.factors: dict[int, _Factor] = {}
        spark = cells.sparkSession
        # Two places per factor, written in turn: the one in use is never overwritten,
        # and storage does not grow with the number of sweeps.
        self.folder = folder
        self.turns = [0] * len(extents)
        # Heavy keys of the modes too wide to broadcast, found once per run.
        self.heavy = {
            m: put(heavy_keys(cells, mode_col(m)), f"{folder}/heavy-{m}")
            for m, n in enumerate(self.total)
            if not fits_broadcast(spark, n, _row_bytes(rank))
        }
        # Where such modes are, cells are laid out once and stay where they are.
        self.layout = BlockLayout(cells, self.total, self.heavy, folder) if self.heavy and lay_out else None
        self.cells = self.layout.cells if self.layout else cells
        per_pass = PASS_COLUMNS // len(extents)
        self.fused = rank <= per_pass

    def start(self, m: int, seed: int) -> None:
        """Random normal rows, the same in every block."""
        spark = self.cells.sparkSession
        drawn = random_rows(spark, m, self.extents[m], self.rank, seed, "normal")
        rows, seen = put_and_measure(drawn, f"{self.folder}/{m}-start", gram_sums(self.rank))
        gram = _symmetric(seen, self.rank)
        if not self.single:
            shift = F.explode(F.array(*[F.lit(int(b)) for b in self.active])).alias("b")
            rows = rows.select("*", shift).selectExpr(
                f"idx + b * {self.extents[m]}L as idx", *flat_cols(self.rank)
            )
        ones = np.ones(self.rank)
        self.factors[m] = _Factor(
            rows, {b: gram for b in self.active}, {b: ones for b in self.active}, rows
        )

    def update(self, n: int, with_error: bool = False) -> tuple[_Factor, dict[int, float]]:
        """The next factor of mode ``n`` and, if asked, the squared error of the model before it."""
        rank, others = self.rank, [m for m in range(len(self.extents)) if m != n]
        inverse = {b: solver([self.factors[m].gram[b] for m in others]) for b in self.active}
        flats = {m: f.flat for m, f in self.factors.items()}
        at = self._model_value() if with_error else None
        sums = rank_sums(
            self.cells, flats, self.total, n, rank, heavy=self.heavy, model_at=at, layout=self.layout
        )
        new = _times(inverse, rank, self.extents[n])
        extra = ["sse"] if with_error else []
        self.turns[n] += 1
        path = f"{self.folder}/{n}-{self.turns[n] % 2}"
        with co_located(self.cells.sparkSession):
            raw, gram, errors = self._write(sums.selectExpr("idx", *new, *extra), n, path, with_error)
        lam = {b: np.sqrt(np.diag(g)) for b, g in gram.items()}
        scaled_gram = {}
        for b, g in gram.items():
            safe = np.where(lam[b] > 0, lam[b], 1.0)
            scaled_gram[b] = g / np.outer(safe, safe)
        return _Factor(raw, scaled_gram, lam, self._scale(raw, n, lam)), errors

    def _write(self, rows: DataFrame, n: int, path: str, with_error: bool):
        """Write the new rows; their Gram matrices and squared errors by block."""
        rank = self.rank
        extent = self.extents[n]
        sums = gram_sums(rank, "a") + ([F.expr("coalesce(sum(sse), 0D) as sse")] if with_error else [])
        if self.single:
            raw, seen = put_and_measure(rows, path, sums)
            found = {0: seen}
        elif len(self.active) * len(sums) <= MEASURES:
            of_block = [
                F.expr(f"coalesce(sum(if(idx div {extent}L = {b}, {x}, 0D)), 0D) as b{b}_{name}")
                for b in self.active
                for name, x in _measured(rank, with_error)
            ]
            raw, seen = put_and_measure(rows, path, of_block)
            found = {
                b: {name: seen[f"b{b}_{name}"] for name, _ in _measured(rank, with_error)} for b in self.active
            }
        else:
            raw = put(rows, path)
            by_block = raw.groupBy(_block_of("idx", extent).alias("block")).agg(*sums)
            found = {r["block"]: r.asDict() for r in by_block.collect()}
        gram = {b: np.zeros((rank, rank)) for b in self.active}
        errors = dict.fromkeys(self.active, 0.0)
        for b, row in found.items():
            gram[b] = _symmetric(row, rank)
            errors[b] = row.get("sse") or 0.0
        return raw, gram, errors

    def _scale(self, raw: DataFrame, n: int, lam: dict[int, np.ndarray]) -> DataFrame:
        inverse = {
            b: [1.0 / v if v > 0 and np.isfinite(v) else 0.0 for v in w] for b, w in lam.items()
        }
        by = _by_block({b: np.array(v) for b, v in inverse.items()}, "idx", self.extents[n])
        return raw.selectExpr("idx", *[f"a{r} * {by.format(r=r)} as f{r}" for r in range(self.rank)])

    def _model_value(self) -> str:
        lam = self.factors[len(self.extents) - 1].lam
        by = _by_block({b: lam[b] for b in self.active}, "i0", self.extents[0])
        return _evaluate(range(len(self.extents)), by, self.rank, outer=False)

    def squared_error(self) -> dict[int, float]:
        """A pass of its own for the error of the model as it stands."""
        frame = self.cells
        modes = range(len(self.extents))
        for m in _join_order(frame.sparkSession, modes, self.total, self.rank):
            frame = _attach(
                frame, m, self.factors[m].flat, self.total[m], range(self.rank), "inner", self.heavy, self.cells, self.layout
            )
        sums = frame.groupBy(_block_of("i0", self.extents[0]).alias("of")).agg(
            F.expr(f"sum(power({self._model_value()} - value, 2)) as sse")
        )
        with co_located(frame.sparkSession):
            rows = sums.collect()
        return {b: 0.0 for b in self.active} | {r.of: r.sse for r in rows}

    def drop(self) -> None:
        """The laid out cells are done with."""
        if self.layout is not None:
            self.layout.drop()

    def retire(self, done: Sequence[int]) -> None:
        """Go on without the blocks that have converged."""
        self.active = [b for b in self.active if b not in done]
        if self.active:
            self.cells = self.cells.where(_block_of("i0", self.extents[0]).isin(self.active))


def update_factor(tensor: TensorFrame, model: CPModel, n: int) -> tuple[DataFrame, list[float]]:
    """One least-squares update, as the sweeps make it: the new factor of mode ``n`` with columns
    of length 1, complete over the extent, and the column lengths."""
    if model.n_modes != tensor.n_modes or not 0 <= n < tensor.n_modes:
        raise ValueError("model and mode must fit the tensor")
    rank = model.rank
    # A single update does not pay for laying the cells out.
    run = _Sweeper(tensor.frame, model.shape, rank, (0,), new_folder(tensor.spark, "factor"), lay_out=False)
    for m in range(model.n_modes):
        if m != n:
            flat = model.flat(m)
            run.factors[m] = _Factor(flat, {0: gram_matrix(model.factors[m], rank)}, {0: np.ones(rank)}, flat)
    new, _ = run.update(n)
    return complete(pack(new.flat, rank), model.shape[n], rank), [float(v) for v in new.lam[0]]


def _run_sweeps(run: _Sweeper, norms: dict[int, float], max_iter: int, tol: float, seed: int):
    """Sweeps until every block has come to its end: errors and weights by block, the factors'
    tables by mode, and the blocks whose weights overflowed."""
    extents, rank, folder = run.extents, run.rank, run.folder
    n_modes, blocks = len(extents), list(run.active)
    for m in range(0 if max_iter == 0 else 1, n_modes):
        run.start(m, seed)
    errors: dict[int, list[float]] = {b: [] for b in blocks}
    lam: dict[int, np.ndarray] = {}
    parts: list[list[DataFrame]] = [[] for _ in extents]
    failed: list[int] = []

    def keep(done: Sequence[int]) -> None:
        for m in range(n_modes):
            rows = run.factors[m].flat.select(
                _block_of("idx", extents[m]).alias("block"),
                F.expr(f"idx % {extents[m]}L").alias("idx"),
                *flat_cols(rank),
            )
            if not run.single:
                # Other blocks go on and write over these files.
                rows = put(rows.where(F.col("block").isin(list(done))), f"{folder}/{m}-kept-{len(lam)}")
            parts[m].append(rows)
        for b in done:
            lam[b] = run.factors[n_modes - 1].lam[b]

    ahead: _Factor | None = None
    for sweep in range(max_iter):
        run.factors[0] = ahead if ahead is not None else run.update(0)[0]
        for m in range(1, n_modes):
            run.factors[m] = run.update(m)[0]
        weights = run.factors[n_modes - 1].lam
        broken = [b for b in run.active if not np.all(np.isfinite(weights[b]))]
        if broken:
            failed += broken
            run.retire(broken)
            if not run.active:
                break
        if run.fused and sweep + 1 < max_iter:
            ahead, squared = run.update(0, with_error=True)
        else:
            ahead, squared = None, run.squared_error()
        done = []
        for b in run.active:
            before = errors[b][-1] if errors[b] else 0.0
            now = float(np.sqrt(squared[b]) / norms[b]) if norms.get(b) else 0.0
            errors[b].append(now)
            if abs(before - now) <= tol:
                done.append(b)
        if done:
            keep(done)
            run.retire(done)
            if not run.active:
                break
    if run.active:
        if max_iter == 0:
            for f in run.factors.values():
                f.lam = {b: np.ones(rank) for b in run.active}
        keep(run.active)
    return errors, lam, parts, failed


def fit_blocks(
    cells: DataFrame, extents: Shape, rank: int, blocks: Sequence[int] = (0,),
    max_iter: int = 500, tol: float = 1e-4, seed: int = 6, restarts: int | None = None,
    folder: str | None = None,
) -> BlockFit:
    """Fit independent tensors of one shape in the same jobs, each to its own end.

    ``cells`` holds block ``b`` at ``b * extent`` and up on every mode and should
    be cheap to read again.  A block stops when its error changes by at most
    ``tol`` (the first error is compared with 0); a block whose weights overflow is
    started anew from other random factors, at most ``restarts`` times (without
    limit if None).  The result
    is read from tables in ``folder`` (a new one unless given).
    """
    if rank <= 0:
        raise ValueError(f"rank must be positive, got {rank}")
    if max_iter < 0:
        raise ValueError(f"max_iter must not be negative, got {max_iter}")
    if tol < 0:
        raise ValueError(f"tol must not be negative, got {tol}")
    n_modes = len(extents)
    if n_modes < 2:
        raise ValueError("at least two modes are needed")
    norms = {
        r.block: float(np.sqrt(r.n))
        for r in cells.groupBy(_block_of("i0", extents[0]).alias("block")).agg(square_norm(cells).alias("n")).collect()
    }
    if not norms:
        max_iter = 0  # no cells at all
    folder = folder or new_folder(cells.sparkSession, "factors")
    run = _Sweeper(cells, extents, rank, blocks, folder, lay_out=max_iter > 0)
    try:
        errors, lam, parts, failed = _run_sweeps(run, norms, max_iter, tol, seed)
    finally:
        run.drop()
    if failed:
        if restarts == 0:
            raise ArithmeticError(f"weights overflowed in blocks {failed}")
        again = fit_blocks(
            cells.where(_block_of("i0", extents[0]).isin(failed)), extents, rank, failed,
            max_iter, tol, seed + 1, None if restarts is None else restarts - 1, f"{folder}/again",
        )
        for m in range(n_modes):
            parts[m].append(again.factors[m])
        lam |= again.lam
        errors |= again.errors
    return BlockFit([reduce(DataFrame.unionByName, p) for p in parts], lam, errors)


def cp_als(
    tensor: TensorFrame, rank: int = 10, max_iter: int = 500, tol: float = 1e-4, seed: int = 6,
    trace: list[float] | None = None, restarts: int | None = None,
) -> CPModel:
    """CP model of a tensor of two or more modes by alternating least squares.

    Stops when the relative error on the stored cells changes by at most ``tol``.
    Cells that are not read from storage are written out once first, since every
    sweep reads them once per mode.  ``trace`` receives the error of each sweep.
    Weights that overflow start the fit anew, ``restarts`` times at most if given.
    """
    shape = tensor.shape
    with Scratch(tensor.spark, "als") as scratch:
        cells = tensor.frame if tensor.stored or max_iter == 0 else scratch.stage(tensor.frame, "cells")
        fit = fit_blocks(cells, shape, rank, (0,), max_iter, tol, seed, restarts)
    if trace is not None:
        trace.extend(fit.errors[0])
    factors = [
        complete(pack(f.drop("block"), rank), n, rank) for f, n in zip(fit.factors, shape, strict=True)
    ]
    return CPModel(factors, fit.lam[0], shape)


def predict(coords: DataFrame, model: CPModel) -> DataFrame:
    """The model's value at given coordinates, as the input columns and ``predicted``."""
    frame = coords
    modes = range(model.n_modes)
    ranks = range(model.rank)
    for m in _join_order(coords.sparkSession, modes, model.shape, model.rank):
        frame = _attach(frame, m, model.flat(m), model.shape[m], ranks, "left", None, coords)
    lam = _by_block({0: np.array(model.lam)}, "", 1)
    value = F.expr(_evaluate(modes, lam, model.rank, outer=True)).alias("predicted")
    return frame.select(*coords.columns, value)


def reconstruct(model: CPModel) -> TensorFrame:
    """The dense tensor a model stands for."""
    grid = index_grid(model.factors[0].sparkSession, model.shape)
    cells = predict(grid, model).withColumnRenamed("predicted", "value")
    return TensorFrame(cells, model.shape, unique=True)


def relative_error(tensor: TensorFrame, model: CPModel) -> DataFrame:
    """One row: root of the squared differences on the stored cells over the norm;
    both sums come from one pass."""
    both = predict(tensor.frame, model)
    gap = F.col("predicted") - F.col("value")
    sums = both.agg(
        F.coalesce(F.sum(gap * gap), F.lit(0.0)).alias("gap"), square_norm(both).alias("all")
    )
    return sums.select(ratio(F.sqrt("gap"), F.sqrt("all")).alias("error"))
