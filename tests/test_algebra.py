"""Construction, projections, products, aggregates."""

import numpy as np
import pytest
from dense_tools import dense, factor
from pyspark.sql import functions as F

from gridloom.operators import aggregates, append, factors, modes, products
from gridloom.sources import (
    densify,
    empty_tensor,
    from_arrays,
    from_coo,
    index_grid,
    slice_batches,
    slice_window,
)
from gridloom.tensor import TensorFrame


def one(df):
    return df.first()[0]


def test_coordinates(spark):
    df = spark.createDataFrame([(3, 2, 1, 1.0)], "a int, b int, c int, x double")
    t = from_coo(df, ["a", "b", "c"], "x")
    assert t.shape == (4, 3, 2)
    four = modes.append_modes(t, 0)
    assert four.frame.first()[:4] == (3, 2, 1, 0)
    assert modes.drop_modes(four, 1, 3).frame.first()[:2] == (3, 1)
    assert modes.keep_modes(t, 1).frame.first()[0] == 2
    assert modes.with_mode(t, 1, 200).frame.first()[:3] == (3, 200, 1)
    assert modes.keep_modes(t, 2, 0).frame.first()[:2] == (3, 1)
    assert modes.map_modes(t, lambda i, m: i * 10 + m).frame.first()[:3] == (30, 21, 12)


def test_repeated_cells_are_summed_and_bad_ones_refused(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.0)], "i int, x double")
    t = from_coo(df, ["i"], "x")
    assert sorted(map(tuple, t.frame.collect())) == [(0, 3.0), (1, 5.0)]
    with pytest.raises(Exception, match="null index"):
        from_coo(df.selectExpr("nullif(i, 1) as i", "x"), ["i"], "x").frame.collect()
    with pytest.raises(Exception, match="null value"):
        from_coo(df.selectExpr("i", "nullif(x, 5) as x"), ["i"], "x").frame.collect()
    with pytest.raises(Exception, match="outside"):
        from_coo(df, ["i"], "x", (1,)).frame.collect()


def test_empty_tensor(spark):
    t = empty_tensor(spark, (2, 3))
    assert t.nnz() == 0 and t.norm() == 0.0 and t.forall(lambda v: v > 0)
    assert dense(densify(t)).shape == (2, 3)
    assert densify(t).nnz() == 6
    assert one(products.dot(empty_tensor(spark, (4,)), empty_tensor(spark, (4,)))) == 0.0
    assert {r.w for r in aggregates.slice_weights(t).collect()} == {0.0}


def test_vectors(tensor):
    v1, v4 = tensor([2.0, 2, 2, 2]), tensor([1.0, 2, 3, 4])
    assert one(products.dot(v1, v4)) == 20
    scaled, length = aggregates.normalize(v1)
    assert one(length) == 4
    assert dense(scaled).tolist() == [0.5] * 4
    assert one(products.multi_dot()) == 0.0
    assert one(products.multi_dot(v1, v4, v4)) == 60
    zero, _ = aggregates.normalize(tensor([0.0, 0.0], keep_zeros=True))
    assert dense(zero).tolist() == [0.0, 0.0]


M1 = np.array([[1.0, 2, 3]] * 3)
M2 = np.array([[1.0, 2, 3], [4, 5, 6], [0, 0, 0]])


@pytest.mark.parametrize("m", [M1, M2])
def test_matrices(tensor, factor_table, m):
    t = tensor(m, keep_zeros=True)
    assert np.array_equal(dense(t), m)
    assert np.array_equal(dense(modes.transpose(t)), m.T)
    assert np.array_equal(dense(factors.gramian_coo(t)), m.T @ m)
    assert np.array_equal(dense(products.matmul(modes.transpose(t), t)), m.T @ m)
    gram = np.zeros((3, 3))
    for row in factors.gramian(factor_table(m), 3).collect():
        gram[row.r, row.s] = row.value
    assert np.array_equal(gram, m.T @ m)
    scaled, lam = factors.normalize_columns(factor_table(m), 3)
    lengths = [r.lam for r in lam.orderBy("r").collect()]
    assert np.allclose(lengths, np.linalg.norm(m, axis=0))
    assert np.allclose(factor(scaled, 3, 3) * lengths, m)
    columns = [modes.column(t, c) for c in range(3)]
    assert np.array_equal(dense(factors.from_columns(columns)), m)
    rows = factors.rows_from_columns(t.frame, 3, "i0", "i1")
    assert np.array_equal(factor(rows, 3, 3), m)
    assert dense(modes.column(t, 1)).tolist() == m[:, 1].tolist()


def test_wide_gram_matches_narrow(spark, factor_table):
    x = np.random.default_rng(1).normal(size=(40, 20))
    gram = np.zeros((20, 20))
    for row in factors.gramian(factor_table(x), 20).collect():
        gram[row.r, row.s] = row.value
    assert np.allclose(gram, x.T @ x)


def test_from_arrays_keeps_zeros(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "id int, a array<float>")
    t = from_arrays(df, "id", "a", (2, 2))
    assert t.nnz() == 4 and dense(t).tolist() == [[1, 0], [0, 2]]


def test_densify_and_grid(spark, tensor):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 5, 6)) * (rng.random((7, 5, 6)) < 0.2)
    full = densify(tensor(x))
    assert full.nnz() == x.size and np.array_equal(dense(full), x)
    grid = {tuple(r) for r in index_grid(spark, (7, 5, 6)).collect()}
    assert grid == set(np.ndindex(7, 5, 6))
    plan = index_grid(spark, (7, 5, 6))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Exchange" not in plan


def test_densify_refuses_cells_outside(spark):
    df = spark.createDataFrame([(0, 9, 1.0)], "i0 bigint, i1 bigint, value double")
    with pytest.raises(Exception, match="outside the shape"):
        densify(TensorFrame(df, (2, 2), unique=True)).frame.collect()


def test_slices(tensor):
    x = np.random.default_rng(0).random((3, 4, 7))
    t = tensor(x)
    assert np.array_equal(dense(slice_window(t, 2, 4, 99)), x[:, :, 4:])
    assert slice_window(t, 2, 7, 9) is None
    batches = slice_batches(t, 2, 3)
    assert [r[0] for r in batches.select("batch").distinct().orderBy("batch").collect()] == [0, 1, 2]
    last = TensorFrame(batches.where("batch = 2").drop("batch"), (3, 4, 1))
    assert np.array_equal(dense(last), x[:, :, 6:])


def test_elementwise(tensor):
    a, b = np.array([1.0, 0, 3, 0]), np.array([0, 2.0, 4, 0])
    assert dense(tensor([1.0, 0]) - tensor([0, 1.0])).tolist() == [1, -1]
    both = products.elementwise(tensor(a), tensor(b), lambda x, y: x * y)
    assert both.nnz() == 1 and dense(both).tolist() == [0, 0, 12, 0]
    either = products.elementwise_full(tensor(a), tensor(b), F.greatest)
    assert either.nnz() == 3 and dense(either).tolist() == [1, 2, 4, 0]
    same = tensor(a) - tensor(a)
    assert same.nnz() == 2 and same.norm() == 0  # zeros stay stored
    assert one(aggregates.all_close(tensor(a), tensor(a + 5e-7)))
    assert not one(aggregates.all_close(tensor(a), tensor(b)))
    with pytest.raises(ValueError, match="shapes differ"):
        products.hadamard(tensor(M1), tensor(M1[:2]))


@pytest.mark.parametrize("widths", [(4, 3), (4, 90), (4, 300)])
def test_mode_multiply(spark, tensor, widths):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 4, 6)) * (rng.random((5, 4, 6)) < 0.5)
    y = rng.normal(size=widths) * (rng.random(widths) < 0.5)
    got = products.mode_multiply(tensor(x), 1, tensor(y), 0)
    assert got.shape == (5, 6, widths[1])
    assert np.allclose(dense(got), np.einsum("abc,bd->acd", x, y))
    met = np.einsum("abc,bd->acd", x != 0, (y != 0).astype(int))
    assert got.nnz() == np.count_nonzero(met)


def test_mode_multiply_by_shuffle_with_heavy_keys(shuffled, tensor):
    """One index holds most of both sides; the plan spreads it and the sums stay whole."""
    rng = np.random.default_rng(3)
    x = rng.integers(1, 9, size=(60, 30)) * (rng.random((60, 30)) < 0.1).astype(float)
    y = rng.integers(1, 9, size=(30, 70)) * (rng.random((30, 70)) < 0.1).astype(float)
    x[:, 7], y[7, :] = 2.0, 3.0
    got = products.mode_multiply(tensor(x), 1, tensor(y), 0)
    assert np.array_equal(dense(got), x @ y)
    plan = got.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "_salt_right" not in plan


def test_mode_multiply_vec_keeps_groups(tensor, spark):
    x = np.arange(1.0, 13).reshape(3, 4)
    v = np.array([0, 2.0, 0, 1])
    got = products.mode_multiply_vec(tensor(x), 1, tensor(v))
    assert got.nnz() == 3 and np.allclose(dense(got), x @ v)
    nothing = products.mode_multiply_vec(tensor(x), 1, empty_tensor(spark, (4,)))
    assert nothing.nnz() == 3 and dense(nothing).tolist() == [0, 0, 0]


def test_mode_multiply_vec_by_shuffle(shuffled, tensor):
    x = np.arange(1.0, 13).reshape(3, 4)
    got = products.mode_multiply_vec(tensor(x), 1, tensor([0, 2.0, 0, 1]))
    assert np.allclose(dense(got), x @ [0, 2.0, 0, 1])


def test_append_on_any_mode(tensor):
    a, b = np.ones((2, 3, 4)), np.full((2, 2, 4), 5.0)
    assert np.array_equal(dense(append.mode_append(tensor(a), tensor(b), 1)), np.concatenate([a, b], 1))
    with pytest.raises(ValueError, match="extents differ"):
        append.mode_append(tensor(a), tensor(b), 2)


def test_slice_weights_and_merge(tensor):
    x = np.random.default_rng(0).random((3, 4, 6))
    x[:, 2, :] = 0  # a slice without cells keeps its place

    def weights(a):
        return {(m, i): (np.moveaxis(a, m, 0)[i] ** 2).sum() for m in range(3) for i in range(a.shape[m])}

    def table(df):
        return {(r.mode, r.idx): r.w for r in df.collect()}

    assert table(aggregates.slice_weights(tensor(x))) == pytest.approx(weights(x))
    merged = aggregates.merge_weights(
        aggregates.slice_weights(tensor(x[:, :, :4])), aggregates.slice_weights(tensor(x[:, :, 4:])), 2, 4
    )
    assert table(merged) == pytest.approx(weights(x))


def test_slice_weights_shuffle_once(tensor):
    plan = aggregates.slice_weights(tensor(M2), complete=False)._jdf.queryExecution().executedPlan().toString()
    # One exchange to sum repeated cells of the input, one for the weights.
    assert plan.count("Exchange hashpartitioning") == 2


def test_signs_and_means(spark, factor_table):
    f = factor_table([[1.0, -1, 0], [2, -2, 0], [-3, 3, 1]])
    g = factor_table([[1.0, 1, -1], [1, 1, -1], [1, 1, 1]])
    signs = {r.r: r.sign for r in factors.sign_agreement(f, g, 3).collect()}
    assert signs == {0: 1.0, 1: -1.0, 2: -1.0}
    both = f.withColumn("rep", F.lit(0)).unionByName(g.where("idx < 2").withColumn("rep", F.lit(1)))
    mean = factor(factors.mean_factors(both, 3, 2), 3, 3)
    assert np.allclose(mean, [[1, 0, -0.5], [1.5, -0.5, -0.5], [-1.5, 1.5, 0.5]])


def test_a_heavy_pair_of_a_long_and_a_short_side_is_spread_on_the_long_one(spark, monkeypatch):
    from gridloom.plans import joins

    left = spark.range(3000).selectExpr("id % 3 AS k", "id AS x")
    right = spark.range(60).selectExpr("id % 3 AS k", "id AS y")
    want = sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
    assert joins.heavy_pairs(left, right, "k").count() == 0
    monkeypatch.setattr(joins, "LEAST_PAIRS", 4000)
    heavy = joins.heavy_pairs(left, right, "k").collect()
    assert [(r._p, r._q) for r in heavy] == [(5, 1)] * 3
    for one, two in ((left, right), (right, left)):
        met = joins.salted_join(one, two, "k", right_unique=False)
        assert sorted(map(tuple, met.select("k", "x", "y").collect())) == want


@pytest.mark.parametrize("least", [250_000, 62_500, 15_625])
def test_a_key_heavy_on_both_sides_is_shared_out_on_a_grid(spark, monkeypatch, least):
    """A third of both sides: the rows shipped grow with the root of the cells."""
    from gridloom.plans import joins

    key = "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k"
    left = spark.range(3000).selectExpr(key, "id AS x")
    right = spark.range(3000).selectExpr(key, "id AS y")
    monkeypatch.setattr(joins, "LEAST_PAIRS", least)
    (heavy,) = joins.heavy_pairs(left, right, "k").collect()
    cells = -(-1000 * 1000 // least)
    assert heavy.k == -1 and heavy._p * heavy._q >= cells
    assert 1000 * (heavy._p + heavy._q) <= 2.3 * 1000 * cells**0.5
    met = joins.salted_join(left, right, "k", right_unique=False)
    assert met.count() == 1000 * 1000 + 2000
    assert met.where("k = -1").distinct().count() == 1000 * 1000


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_labels_are_numbered_by_ranges(spark, monkeypatch, size):
    from gridloom.catalog import tables

    monkeypatch.setattr(tables, "LABELS_A_RANGE", size)
    words = [f"{'abc'[k % 3]}{k * 7919 % 1000}" for k in range(100)] + ["", "é", "a b"]
    rows = spark.createDataFrame([(w, k) for k, w in enumerate(words * 3)], "label string, k int").repartition(5)
    numbers = tables.label_numbers(rows, "label", "number")
    got = {r.label: r.number for r in numbers.collect()}
    assert got == {w: k for k, w in enumerate(sorted(set(words), key=lambda w: w.encode()))}
    if size == 7:
        plan = numbers._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    assert tables.label_numbers(rows.limit(0), "label", "number").collect() == []
    with pytest.raises(Exception, match="null label"):
        tables.label_numbers(rows.unionByName(spark.sql("select null as label, 1 as k")), "label", "number")


def test_one_exchange_for_any_number_of_vectors(shuffled, tensor):
    u, v = tensor(np.arange(1.0, 7)).store(), tensor(np.array([0, 2.0, 0, 1, 1, 3])).store()
    found = products.multi_dot(u, v, u, v)
    plan = found._jdf.queryExecution().executedPlan().initialPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    x, y = np.arange(1.0, 7), np.array([0, 2.0, 0, 1, 1, 3])
    assert found.first()[0] == (x * y * x * y).sum()
    with pytest.raises(ValueError, match="lengths"):
        products.multi_dot(u, tensor(np.ones(5)))
    close = aggregates.all_close(u, v)
    plan = close._jdf.queryExecution().executedPlan().initialPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert not close.first()[0] and aggregates.all_close(u, u).first()[0]
