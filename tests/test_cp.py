"""CP models and their fitting, against dense NumPy."""

import string
from fractions import Fraction

import numpy as np
import pytest
from dense_tools import factor
from pyspark.sql import functions as F

from gridloom.model import make_model
from gridloom.operators.factors import unpack
from gridloom.plans import cp, qr
from gridloom.plans.materialize import Scratch, stage
from gridloom.sources import empty_tensor, random_factors
from gridloom.sources.construct import random_rows
from gridloom.tensor import TensorFrame


def full(factors, lam=None):
    """Dense tensor of NumPy factors."""
    rank = factors[0].shape[1]
    lam = np.ones(rank) if lam is None else lam
    letters = string.ascii_lowercase[: len(factors)]
    spec = ",".join(f"{c}z" for c in letters)
    return np.einsum(f"z,{spec}->{letters}", lam, *factors)


def sums_of(x, factors, n):
    letters = string.ascii_lowercase[: x.ndim]
    others = [m for m in range(x.ndim) if m != n]
    spec = ",".join(f"{letters[m]}z" for m in others)
    return np.einsum(f"{letters},{spec}->{letters[n]}z", x, *[factors[m] for m in others])


def numpy_als(x, start, sweeps, tol):
    """The rules of the loop, dense. Error on the stored (non-zero) cells."""
    factors, errors, before = [f.copy() for f in start], [], 0.0
    for _ in range(sweeps):
        for n in range(x.ndim):
            v = np.ones((start[0].shape[1],) * 2)
            for m in range(x.ndim):
                if m != n:
                    v *= factors[m].T @ factors[m]
            a = sums_of(x, factors, n) @ np.linalg.pinv(v, hermitian=True)
            lam = np.linalg.norm(a, axis=0)
            factors[n] = a / np.where(lam > 0, lam, 1)
        gap = (full(factors, lam) - x)[x != 0]
        errors.append(np.linalg.norm(gap) / np.linalg.norm(x))
        if abs(before - errors[-1]) <= tol:
            break
        before = errors[-1]
    return factors, lam, errors


def starting_factors(spark, shape, rank, seed=6):
    out = []
    for m, n in enumerate(shape):
        rows = random_rows(spark, m, n, rank, seed, "normal").orderBy("idx").collect()
        out.append(np.array([[r[f"f{k}"] for k in range(rank)] for r in rows]))
    return out


@pytest.fixture
def example(factor_table):
    parts = [[[2, 2], [3, 3], [4, 4]], [[1, 1], [2, 2]], [[5, 5], [4, 4], [3, 3]]]
    return make_model([factor_table(p) for p in parts], (3, 2, 3), 2, (5.0, 5.0))


def test_prediction(spark, example):
    coords = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 1, 2)], "i0 bigint, i1 bigint, i2 bigint")
    got = {(r.i0, r.i1, r.i2): r.predicted for r in cp.predict(coords, example).collect()}
    assert got == {(0, 0, 0): 100.0, (1, 0, 0): 150.0, (2, 1, 2): 240.0}


def test_error_after_a_known_change(example):
    cells = cp.reconstruct(example)
    first = (F.col("i0") == 0) & (F.col("i1") == 0) & (F.col("i2") == 0)
    changed = TensorFrame(
        cells.frame.withColumn("value", F.when(first, F.col("value") - 3.0).otherwise(F.col("value"))), (3, 2, 3)
    )
    error = cp.relative_error(changed, example).first()[0]
    assert abs(error - 3.0 / changed.norm()) <= 1e-7


@pytest.mark.parametrize("shape", [(6, 5), (5, 4, 6), (4, 3, 5, 2)])
def test_mttkrp_and_update(spark, tensor, shape):
    rng = np.random.default_rng(0)
    x = rng.normal(size=shape) * (rng.random(shape) < 0.6)
    x[1] = 0  # a slice without cells
    tables = random_factors(spark, shape, 3, seed=2)
    arrays = [factor(f, n, 3) for f, n in zip(tables, shape, strict=True)]
    model = make_model(tables, shape, 3)
    for n in range(len(shape)):
        assert np.allclose(factor(cp.mttkrp(tensor(x), model, n), shape[n], 3), sums_of(x, arrays, n))
    new, lam = cp.update_factor(tensor(x), model, 0)
    v = np.ones((3, 3))
    for m in range(1, len(shape)):
        v *= arrays[m].T @ arrays[m]
    a = sums_of(x, arrays, 0) @ np.linalg.pinv(v)
    assert np.allclose(lam, np.linalg.norm(a, axis=0))
    assert np.allclose(factor(new, shape[0], 3), a / lam)
    assert new.count() == shape[0]


def test_high_rank_in_several_passes(spark, tensor, monkeypatch):
    monkeypatch.setattr(cp, "PASS_COLUMNS", 4)
    x = np.random.default_rng(0).normal(size=(5, 4, 6))
    tables = random_factors(spark, x.shape, 5, seed=2)
    arrays = [factor(f, n, 5) for f, n in zip(tables, x.shape, strict=True)]
    got = cp.mttkrp(tensor(x), make_model(tables, x.shape, 5), 1)
    assert np.allclose(factor(got, 4, 5), sums_of(x, arrays, 1))


@pytest.mark.parametrize("shape", [(6, 5), (7, 4, 5), (4, 3, 5, 2)])
def test_als_follows_the_dense_loop(spark, tensor, shape):
    rng = np.random.default_rng(4)
    x = rng.random(shape) * (rng.random(shape) < 0.8)
    trace = []
    model = cp.cp_als(tensor(x), rank=2, max_iter=4, tol=1e-9, trace=trace)
    factors, lam, errors = numpy_als(x, starting_factors(spark, shape, 2), 4, 1e-9)
    assert np.allclose(trace, errors, atol=1e-9)
    assert np.allclose(model.lam, lam)
    for m, n in enumerate(shape):
        assert np.allclose(factor(model.factors[m], n, 2), factors[m], atol=1e-7)


def test_als_by_shuffle_joins(shuffled, spark, tensor):
    """No factor fits a broadcast: heavy indexes are spread, the result is the same."""
    rng = np.random.default_rng(5)
    x = rng.random((30, 12, 5)) * (rng.random((30, 12, 5)) < 0.1)
    x[3] = rng.random((12, 5))
    trace = []
    cp.cp_als(tensor(x), rank=2, max_iter=2, tol=0.0, trace=trace)
    _, _, errors = numpy_als(x, starting_factors(spark, x.shape, 2), 2, 0.0)
    assert np.allclose(trace, errors, atol=1e-9)


def test_als_finds_a_low_rank_tensor(spark):
    shape = (3, 3, 3)
    label = cp.reconstruct(make_model(random_factors(spark, shape, 2, seed=1), shape, 2))
    trace = []
    model = cp.cp_als(label, rank=2, tol=1e-4, max_iter=40, trace=trace)
    assert cp.relative_error(label, model).first()[0] == pytest.approx(trace[-1], abs=1e-9)
    assert trace[-1] < 0.05 and trace[-1] <= trace[0]


def test_als_stops_at_once_when_the_first_error_is_small(spark, tensor):
    x = np.outer([1.0, 2, 3], [1.0, 4])  # rank 1: exact after one sweep
    trace = []
    cp.cp_als(tensor(x), rank=1, tol=1e-6, trace=trace)
    assert len(trace) == 1 and trace[0] < 1e-6


def test_als_rules(spark, tensor):
    t = tensor(np.ones((2, 2, 2)))
    for bad in ({"rank": 0}, {"max_iter": -1}, {"tol": -1.0}):
        with pytest.raises(ValueError):
            cp.cp_als(t, **{"rank": 2, **bad})
    raw = cp.cp_als(t, rank=2, max_iter=0)
    assert raw.lam == (1.0, 1.0)
    start = starting_factors(spark, (2, 2, 2), 2)
    assert all(np.allclose(factor(f, 2, 2), s) for f, s in zip(raw.factors, start, strict=True))


def test_als_on_nothing(spark):
    model = cp.cp_als(empty_tensor(spark, (2, 3, 2)), rank=2)
    assert [f.count() for f in model.factors] == [2, 3, 2]


def test_blocks_are_fitted_independently(spark, tensor):
    """Two tensors side by side end where each ends alone, at its own sweep."""
    rng = np.random.default_rng(7)
    shape = (5, 4, 3)
    easy = full([rng.random((n, 1)) for n in shape])
    hard = rng.random(shape)
    cells = None
    for b, x in enumerate((easy, hard)):
        part = tensor(x).frame.select(
            *[(F.col(f"i{m}") + b * n).alias(f"i{m}") for m, n in enumerate(shape)], "value"
        )
        cells = part if cells is None else cells.unionByName(part)
    fit = cp.fit_blocks(stage(cells, "test"), shape, 2, (0, 1), max_iter=8, tol=1e-3)
    start = starting_factors(spark, shape, 2)
    for b, x in enumerate((easy, hard)):
        factors, lam, errors = numpy_als(x, start, 8, 1e-3)
        assert np.allclose(fit.errors[b], errors, atol=1e-7)
        for m, n in enumerate(shape):
            rows = fit.factors[m].where(F.col("block") == b).collect()
            got = np.zeros((n, 2))
            for r in rows:
                got[r.idx] = (r.f0, r.f1)
            assert np.allclose(full([got]), full([factors[m]]), atol=1e-5)
    assert len(fit.errors[0]) < len(fit.errors[1])


def test_overflow_restarts_and_then_fails(spark, tensor):
    cells = stage(tensor(np.full((2, 2, 2), 1e300)).frame, "test")
    with pytest.raises(ArithmeticError):
        cp.fit_blocks(cells, (2, 2, 2), 2, max_iter=3, restarts=1)


def test_plans_do_not_grow_with_the_sweeps(spark, tensor):
    x = np.random.default_rng(0).random((4, 3, 3))

    def plan_after(sweeps):
        fit = cp.fit_blocks(stage(tensor(x).frame, "test"), x.shape, 2, max_iter=sweeps, tol=0.0)
        return fit.factors[2]._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert plan_after(7) == plan_after(2)


def test_scratch_tables_are_removed(spark):
    kept = stage(spark.range(3), "kept")
    with Scratch(spark, "work") as scratch:
        assert scratch.stage(spark.range(5), "a").count() == 5
        folder = scratch.folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    assert not files.exists(path) and kept.count() == 3


def test_pseudo_inverse(factor_table):
    x = np.random.default_rng(0).normal(size=(9, 4))
    got = factor(qr.pseudo_inverse(factor_table(x), 4), 9, 4).T
    assert np.allclose(got, np.linalg.pinv(x))


def exact_pinv(x):
    """Pseudo-inverse of a matrix of full column rank in rational numbers."""
    rows = [[Fraction(float(v)) for v in row] for row in x]
    rank = len(rows[0])
    system = [
        [sum(row[i] * row[j] for row in rows) for j in range(rank)] + [Fraction(int(i == j)) for j in range(rank)]
        for i in range(rank)
    ]
    for i in range(rank):
        system[i] = [v / system[i][i] for v in system[i]]
        for j in range(rank):
            if j != i:
                system[j] = [a - system[j][i] * b for a, b in zip(system[j], system[i], strict=True)]
    inverse = [line[rank:] for line in system]
    return np.array([[float(sum(a * b for a, b in zip(line, row, strict=True))) for row in rows] for line in inverse])


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_pseudo_inverse_of_an_ill_conditioned_matrix(factor_table, parts):
    """Condition 1e10: its square is beyond doubles, so the Gram matrix loses the small half."""
    rng = np.random.default_rng(1)
    u, v = np.linalg.qr(rng.normal(size=(500, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = (u * np.logspace(0, -10, 6)) @ v.T
    want = exact_pinv(x)
    gram = np.linalg.pinv(x.T @ x, hermitian=True) @ x.T
    assert np.abs(gram - want).max() > 0.1 * np.abs(want).max()
    table = factor_table(x).repartition(parts)
    got = factor(qr.pseudo_inverse(table, 6), 500, 6).T
    assert np.abs(got - want).max() < 1e-6 * np.abs(want).max()
    # NumPy's own way through the singular values comes no nearer.
    assert np.abs(got - want).max() < np.abs(np.linalg.pinv(x) - want).max()


def test_triangle_and_pseudo_inverse_of_odd_matrices(spark, factor_table, monkeypatch):
    x = np.random.default_rng(2).normal(size=(40, 3))
    monkeypatch.setattr(qr, "FAN_IN", 3)
    r = qr.triangle(factor_table(x).repartition(30), 3)
    assert np.allclose(r.T @ r, x.T @ x)
    for odd in (x[:2], np.stack([x[:, 0], 2 * x[:, 0], x[:, 1]], axis=1), np.zeros((5, 3))):
        got = factor(qr.pseudo_inverse(factor_table(odd), 3), len(odd), 3).T
        assert np.allclose(got, np.linalg.pinv(odd))
    empty = spark.createDataFrame([], "idx bigint, vec array<double>")
    assert qr.pseudo_inverse(empty, 3).collect() == []
    with pytest.raises(Exception, match="every row needs 3 numbers"):
        qr.triangle(factor_table(x[:, :2]), 3)


def test_update_is_one_shuffle_of_sums(spark, tensor):
    """The cells meet broadcast factors; only sums per index are exchanged."""
    x = np.random.default_rng(0).random((6, 5, 4))
    t = TensorFrame(stage(tensor(x).frame, "plan"), x.shape, True, True)
    tables = [stage(f, "f") for f in random_factors(spark, x.shape, 3, seed=2)]
    flats = {m: unpack(f, 3) for m, f in enumerate(tables)}
    sums = cp.rank_sums(t.frame, flats, x.shape, 0, 3)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
