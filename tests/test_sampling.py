"""Weighted sampling, numbering, sub-tensors and sub-models."""

import math

import numpy as np
import pytest
from dense_tools import dense
from pyspark.sql import functions as F

from gridloom.functions import hash_uniform
from gridloom.model import make_model
from gridloom.operators import aggregates, ranking, sampling
from gridloom.plans import cp
from gridloom.sources import random_factors
from gridloom.tensor import TensorFrame


def brute_sample(weights, seed, rep, mode, k):
    """The k best scores, from the hashed numbers themselves."""
    import hashlib

    def u(idx):
        digest = hashlib.md5(f"{seed}|{rep}|{mode}|{idx}".encode()).hexdigest()
        return (int(digest[:12], 16) + 0.5) / 16**12

    def place(i):
        return (0, -math.log(u(i)) / weights[i], i) if weights[i] > 0 else (1, 0.0, i)

    return sorted(sorted(range(len(weights)), key=place)[:k])


@pytest.fixture
def weight_table(spark):
    def make(*by_mode):
        rows = [(m, i, float(w)) for m, ws in enumerate(by_mode) for i, w in enumerate(ws)]
        return spark.createDataFrame(rows, "mode int, idx bigint, w double")

    return make


def test_hash_numbers_do_not_depend_on_partitioning(spark):
    u = hash_uniform(1, F.col("id").cast("string"))
    a = spark.range(500).select("id", u.alias("u")).collect()
    b = spark.range(500).repartition(7).select("id", u.alias("u")).collect()
    assert dict(map(tuple, a)) == dict(map(tuple, b))
    values = np.array([r.u for r in a])
    assert 0 < values.min() and values.max() < 1 and abs(values.mean() - 0.5) < 0.05


def test_weighted_sample(spark, weight_table):
    w = np.random.default_rng(0).pareto(1.0, size=200) * 1e6
    w[::7] = 0
    table = weight_table(w)
    for k in (1, 50, 190, 200, 500):
        got = sampling.weighted_sample(table, k, seed=3)
        assert sorted(r.idx for r in got.collect()) == brute_sample(w, 3, 0, 0, k)
    plan = sampling.weighted_sample(table, 50, seed=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_large_samples_by_buckets(spark, weight_table, monkeypatch):
    rng = np.random.default_rng(1)
    by_mode = [rng.pareto(0.5, size=n) * 1e3 for n in (700, 90, 40)]
    by_mode[0][:650] = 0  # the cut lies among the zero weights
    by_mode[1][:] = 1e-300  # and among tiny ones
    by_mode[2][5:] = 0
    sizes = (350, 45, 60)
    table = weight_table(*by_mode)
    plain = sampling.sample_modes(table, sizes, (700, 90, 40), seed=2, reps=3).collect()
    monkeypatch.setattr(sampling, "HEAP_ROWS", 0)
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 0)
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 16)
    monkeypatch.setattr(ranking, "COARSE", 4)
    monkeypatch.setattr(ranking, "FINE", 8)
    bucketed = sampling.sample_modes(table, sizes, (700, 90, 40), seed=2, reps=3).collect()
    assert set(map(tuple, bucketed)) == set(map(tuple, plain))
    assert len(bucketed) == len(plain)
    for rep in range(3):
        for mode, k in enumerate(sizes):
            got = sorted((r.new_idx, r.old_idx) for r in bucketed if (r.rep, r.mode) == (rep, mode))
            want = brute_sample(by_mode[mode], 2, rep, mode, k)
            assert got == list(enumerate(want))
    heap = sampling.weighted_sample(table.where("mode = 0"), 350, seed=2)
    assert sorted(r.idx for r in heap.collect()) == brute_sample(by_mode[0], 2, 0, 0, 350)


def numpy_sample(x, maps, rep):
    at = [[r.old_idx for r in sorted(maps, key=lambda r: r.new_idx) if (r.rep, r.mode) == (rep, m)] for m in range(x.ndim)]
    return x[np.ix_(*at)]


@pytest.mark.parametrize("way", ["broadcast", "shuffle"])
def test_subtensor(request, spark, tensor, way):
    if way == "shuffle":
        request.getfixturevalue("shuffled")
    rng = np.random.default_rng(0)
    x = rng.random((8, 6, 5)) * (rng.random((8, 6, 5)) < 0.6)
    t = tensor(x)
    maps = sampling.sample_modes(aggregates.slice_weights(t), (4, 3, 2), t.shape, seed=1, reps=2)
    sample = sampling.sample_subtensor(t, maps, (4, 3, 2), reps=2)
    rows = maps.collect()
    for rep in range(2):
        got = TensorFrame(sample.where(F.col("rep") == rep).drop("rep"), (4, 3, 2))
        assert np.array_equal(dense(got), numpy_sample(x, rows, rep))


def test_sampled_model_gives_sampled_tensor(spark):
    shape = (5, 5, 5)
    model = make_model(random_factors(spark, shape, 5, seed=0), shape, 5)
    full = cp.reconstruct(model)
    maps = sampling.sample_modes(aggregates.slice_weights(full), (3, 3, 3), shape, seed=4)
    sample = sampling.sample_subtensor(full, maps, (3, 3, 3)).drop("rep")
    rows = sampling.sample_model(model, maps).drop("rep")
    small = type(model).from_table(rows, model.lam, (3, 3, 3))
    assert cp.relative_error(TensorFrame(sample, (3, 3, 3)), small).first()[0] <= 1e-7


def test_head_and_order(spark, tensor):
    shape = (5, 4)
    model = make_model(random_factors(spark, shape, 2, seed=0), shape, 2)
    head = sampling.head_model(model, (2, 9))
    assert head.shape == (2, 4) and [f.count() for f in head.factors] == [2, 4]
    x = np.arange(1.0, 7).reshape(2, 3)
    order = [(r.i0, r.i1) for r in sampling.sort_by_mode(tensor(x), 1).collect()]
    assert order == sorted(np.ndindex(2, 3), key=lambda c: (c[1], c[0]))
