"""Matching, rescaling, and the incremental step against a dense version of its rules."""

from itertools import permutations

import numpy as np
import pytest
from dense_tools import dense, factor
from pyspark.sql import functions as F
from test_cp import full, numpy_als, starting_factors
from test_sampling import brute_sample

from gridloom.model import CPModel, make_model
from gridloom.operators import aggregates
from gridloom.plans import cp, matching
from gridloom.plans.incremental import append_slice, incremental_step, sample_sizes, start_state, step_seed
from gridloom.plans.materialize import stage
from gridloom.sources import random_factors, slice_window
from gridloom.tensor import TensorFrame


def rep_rows(spark, arrays):
    rows = [
        (rep, i, [float(v) for v in row]) for rep, a in enumerate(arrays) for i, row in enumerate(a)
    ]
    return spark.createDataFrame(rows, "rep int, idx bigint, vec array<double>")


def by_rep(df, rep, n, rank):
    return factor(df.where(F.col("rep") == rep).drop("rep"), n, rank)


def best_order(cost):
    n = len(cost)
    return min(permutations(range(n)), key=lambda p: sum(cost[s, d] for s, d in enumerate(p)))


def test_the_first_of_equal_matchings_at_every_rank():
    rng = np.random.default_rng(0)
    for turn in range(600):
        n = int(rng.integers(1, 8 if turn % 50 == 0 else 6))
        cost = rng.integers(0, 3, (n, n)) / (7.0 if turn % 2 else 1.0)
        want = min(permutations(range(n)), key=lambda p: (round(sum(cost[s, d] for s, d in enumerate(p)), 9), p))
        assert matching._assign(cost) == list(want)
    assert matching._assign(np.zeros((40, 40))) == list(range(40))


@pytest.mark.parametrize("rank", [3, 7])
def test_matching(spark, rank):
    rng = np.random.default_rng(rank)
    fits = [rng.normal(size=(9, rank)) for _ in range(3)]
    refs = [f[:, rng.permutation(rank)] * rng.choice([-1, 1], rank) + rng.normal(size=(9, rank)) * 0.8 for f in fits]
    sim = matching.component_similarity(rep_rows(spark, fits), rep_rows(spark, refs), rank)
    pairs = matching.match_components(sim, rank)
    found = {(r.rep, r.src): r.dst for r in pairs.collect()}
    moved = matching.rearrange(rep_rows(spark, fits), pairs, rank)
    for rep, (f, g) in enumerate(zip(fits, refs, strict=True)):
        cost = 1 - np.abs(f.T @ (g / np.linalg.norm(g, axis=0)))
        order = best_order(cost)
        assert [found[rep, s] for s in range(rank)] == list(order)
        want = np.zeros_like(f)
        want[:, list(order)] = f
        assert np.allclose(by_rep(moved, rep, 9, rank), want)


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 5, 7):
        cost = rng.normal(size=(n, n)).round(1)
        given = matching._assign(cost)
        assert sorted(given) == list(range(n))
        best = sum(cost[s, d] for s, d in enumerate(best_order(cost)))
        assert sum(cost[s, d] for s, d in enumerate(given)) == pytest.approx(best)


def numpy_renorm(mat, ref):
    head = mat[: len(ref)]
    own, want = np.linalg.norm(head, axis=0), np.linalg.norm(ref, axis=0)
    sign = np.where((np.where(ref >= 0, 1, -1) * np.where(head >= 0, 1, -1)).sum(0) >= 0, 1, -1)
    return mat * np.where(own > 0, want / np.where(own > 0, own, 1), 0) * sign


def test_similarity_measures_columns_over_all_reference_rows(spark):
    """A sampled slice without cells has a reference row but no fitted one."""
    fitted = spark.createDataFrame([(0, 0, [1.0, 0.0])], "rep int, idx bigint, vec array<double>")
    reference = spark.createDataFrame(
        [(0, 0, [3.0, 1.0]), (0, 1, [4.0, 0.0])], "rep int, idx bigint, vec array<double>"
    )
    sims = {(r.src, r.dst): r.sim for r in matching.component_similarity(fitted, reference, 2).collect()}
    assert sims == pytest.approx({(0, 0): 0.6, (0, 1): 1.0, (1, 0): 0.0, (1, 1): 0.0})


def test_renorm_uses_the_reference_rows_only(spark):
    rng = np.random.default_rng(0)
    mats = [rng.normal(size=(8, 3)) for _ in range(2)]
    mats[1][:, 2] = 0  # a zero column stays zero
    refs = [rng.normal(size=(5, 3)) for _ in range(2)]
    got = matching.renorm(rep_rows(spark, mats), rep_rows(spark, refs), 3)
    for rep in range(2):
        assert np.allclose(by_rep(got, rep, 8, 3), numpy_renorm(mats[rep], refs[rep]))
    alone = matching.renorm(rep_rows(spark, mats[:1]).drop("rep"), rep_rows(spark, refs[:1]).drop("rep"), 3)
    assert np.allclose(factor(alone, 8, 3), numpy_renorm(mats[0], refs[0]))


def test_update_zeros(spark, factor_table):
    model = make_model([factor_table([[0, 1], [0, 0], [5, 1e-9]]), factor_table([[2, 0]])], (3, 1), 2)
    rows = [(1, 0, 0, [8.0, 8.0]), (0, 0, 0, [0.0, 9.0]), (0, 0, 2, [4.0, 7.0]), (1, 0, 2, [4.0, 6.0])]
    offers = spark.createDataFrame(rows, "rep int, mode int, idx bigint, vec array<double>")
    got = matching.update_zeros(model, offers)
    assert factor(got.factors[0], 3, 2).tolist() == [[8, 1], [0, 0], [5, 7]]
    assert factor(got.factors[1], 1, 2).tolist() == [[2, 0]]
    assert factor(model.factors[0], 3, 2)[0, 0] == 0  # the model handed in is left alone


def numpy_step(spark, x, new, factors, mode, reps, seed, max_iter, tol, sequential):
    """The rules of a step on dense arrays."""
    factors = [f.copy() for f in factors]
    before = [f.copy() for f in factors]
    rank, batch = factors[0].shape[1], new.shape[mode]
    sizes = sample_sizes(x.shape, 2)
    fresh = np.zeros((batch, rank))
    first = 0 if mode else 1
    for rep in range(reps):
        refs_from = factors if sequential else before
        at = []
        for m in range(x.ndim):
            w = (np.moveaxis(x, m, 0) ** 2).reshape(x.shape[m], -1).sum(1)
            at.append(brute_sample(w, step_seed(seed, x.shape[mode]), rep, m, sizes[m]))
        new_at = at[:mode] + [range(batch)] + at[mode + 1 :]
        sample = np.concatenate([x[np.ix_(*at)], new[np.ix_(*new_at)]], axis=mode)
        fit, _, _ = numpy_als(sample, starting_factors(spark, sample.shape, rank), max_iter, tol)
        refs = [f[a] for f, a in zip(refs_from, at, strict=True)]
        lengths = np.linalg.norm(refs[first], axis=0)
        order = best_order(1 - np.abs(fit[first].T @ (refs[first] / np.where(lengths > 0, lengths, 1))))
        lined_up = []
        for f, ref in zip(fit, refs, strict=True):
            moved = np.zeros_like(f)
            moved[:, list(order)] = f
            lined_up.append(numpy_renorm(moved, ref))
        fresh += lined_up[mode][-batch:] / reps
        for m in range(x.ndim):
            rows = factors[m][at[m]]
            factors[m][at[m]] = np.where(np.abs(rows) <= 1e-7, lined_up[m][: len(at[m])], rows)
    factors[mode] = np.vstack([factors[mode], fresh])
    return factors


@pytest.mark.parametrize("mode,sequential", [(2, False), (2, True), (0, False)])
def test_step_follows_the_dense_rules(spark, tensor, mode, sequential):
    rng = np.random.default_rng(3)
    x = rng.random((8, 6, 7)) * (rng.random((8, 6, 7)) < 0.9)
    old, new = np.split(x, [5], axis=mode)
    if mode != 1:
        old[:, 4] = 0  # an index first seen in the new slices
    tables = random_factors(spark, old.shape, 2, seed=1)
    factors = [factor(f, n, 2) for f, n in zip(tables, old.shape, strict=True)]
    if mode != 1:
        factors[1][4] = 0
        tables[1] = tables[1].withColumn(
            "vec", F.when(F.col("idx") == 4, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.col("vec"))
        )
    state = start_state(tensor(old), make_model(tables, old.shape, 2, (2.0, 3.0)))
    got = incremental_step(
        state, tensor(new), mode, factor=2, reps=2, max_iter=3, tol=1e-9, seed=5, sequential=sequential
    )
    want = numpy_step(spark, old, new, factors, mode, 2, 5, 3, 1e-9, sequential)
    assert got.model.shape == x.shape and got.model.lam == (2.0, 3.0)
    for m, n in enumerate(x.shape):
        assert np.allclose(factor(got.model.factors[m], n, 2), want[m], atol=1e-5), m
    assert np.array_equal(dense(got.tensor), np.concatenate([old, new], mode))
    weights = {(r.mode, r.idx): r.w for r in got.weights.collect()}
    both = np.concatenate([old, new], mode)
    assert weights == pytest.approx(
        {(m, i): (np.moveaxis(both, m, 0)[i] ** 2).sum() for m in range(3) for i in range(both.shape[m])}
    )


def test_step_keeps_up_with_a_full_fit(spark):
    """Low-rank data in two batches: the kept-up model fits about as well as a new one."""
    shape, rank = (12, 12, 12), 2
    label = cp.reconstruct(make_model(random_factors(spark, shape, rank, seed=1), shape, rank))
    label = TensorFrame(stage(label.frame, "label"), shape, True, True)
    half = slice_window(label, 2, 0, 6)
    model = cp.cp_als(half, rank=rank, tol=1e-4, max_iter=12)
    state = incremental_step(
        start_state(half, model), slice_window(label, 2, 6, 12), 2, reps=2, tol=1e-4, max_iter=12
    )
    kept_up = cp.relative_error(state.tensor, state.model).first()[0]
    fresh = cp.relative_error(label, cp.cp_als(label, rank=rank, tol=1e-4, max_iter=12)).first()[0]
    assert kept_up < max(0.25, 3 * fresh)


def test_append_slice_on_a_middle_mode(tensor, spark):
    x = np.random.default_rng(0).random((3, 6, 4))
    old, new = x[:, :4], x[:, 4:]
    tables = random_factors(spark, old.shape, 2, seed=0)
    grown = append_slice(start_state(tensor(old), make_model(tables, old.shape, 2)), tensor(new), 1)
    assert np.array_equal(dense(grown.tensor), x)
    want = {(r.mode, r.idx): r.w for r in aggregates.slice_weights(tensor(x)).collect()}
    assert {(r.mode, r.idx): r.w for r in grown.weights.collect()} == pytest.approx(want)
    with pytest.raises(ValueError, match="extents differ"):
        append_slice(start_state(tensor(old), make_model(tables, old.shape, 2)), tensor(x[:2]), 1)


def test_model_table_round_trip(spark, tmp_path):
    from gridloom.sources.storage import read_model, read_tensor, write_model, write_tensor

    shape = (4, 3)
    model = make_model(random_factors(spark, shape, 2, seed=0), shape, 2, (1.5, 2.5))
    write_model(model, str(tmp_path / "model"))
    back = read_model(spark, str(tmp_path / "model"))
    assert isinstance(back, CPModel) and back.lam == (1.5, 2.5) and back.shape == shape
    for m, n in enumerate(shape):
        assert np.array_equal(factor(back.factors[m], n, 2), factor(model.factors[m], n, 2))
    t = cp.reconstruct(model)
    write_tensor(t, str(tmp_path / "tensor"))
    again = read_tensor(spark, str(tmp_path / "tensor"))
    assert again.shape == shape and again.stored and again.unique
    want = full([factor(f, n, 2) for f, n in zip(model.factors, shape, strict=True)], model.lam)
    assert np.allclose(dense(again), want)


def test_every_step_draws_anew_and_a_repeat_draws_the_same(spark, tensor):
    from gridloom.operators.sampling import sample_modes

    t = tensor(np.random.default_rng(8).random((20, 15, 12)) + 0.5)
    state = start_state(t, make_model(random_factors(spark, t.shape, 2, seed=1), t.shape, 2))
    drawn = [
        {tuple(r) for r in sample_modes(state.weights, (10, 7, 6), t.shape, step_seed(0, n), 1).collect()}
        for n in (12, 13, 12)
    ]
    assert drawn[0] == drawn[2] != drawn[1]
