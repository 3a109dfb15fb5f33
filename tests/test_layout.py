"""Cells laid out by blocks: what moves in a sweep, and that results stay the same."""

import numpy as np
import pytest
from dense_tools import factor
from pyspark.sql import functions as F

from gridloom.plans import cp
from gridloom.plans.joins import heavy_keys
from gridloom.plans.layout import CO_PARTITION, BlockLayout, co_located, deal_parts
from gridloom.plans.materialize import new_folder
from gridloom.tensor import mode_col


def skewed_cells(spark, shape=(40, 30, 20)):
    """A third of the cells stand on index 7 of the first mode."""
    rng = np.random.default_rng(3)
    at = {tuple(int(rng.integers(n)) for n in shape) for _ in range(1500)}
    at |= {(7, int(j), int(k)) for j in range(shape[1]) for k in range(shape[2])}
    rows = [(*c, float(rng.random())) for c in sorted(at)]
    return rows, spark.createDataFrame(rows, "i0 bigint, i1 bigint, i2 bigint, value double")


def paths_to_cells(plan, above=()):
    """Names of the operators between the root and each scan of a bucketed table."""
    name = plan.nodeName()
    if "AdaptiveSparkPlan" in name:
        return paths_to_cells(plan.initialPlan(), above)
    here = (*above, plan.simpleStringWithNodeId().split(") ", 1)[-1])
    if "Scan" in name and "Bucketed: true" in plan.verboseString(1000):
        return [here]
    children = plan.children()
    return [p for k in range(children.size()) for p in paths_to_cells(children.apply(k), here)]


def test_cells_are_not_shuffled_in_a_sweep(shuffled, monkeypatch):
    spark = shuffled
    _, cells = skewed_cells(spark)
    run = cp._Sweeper(cells, (40, 30, 20), 2, (0,), new_folder(spark, "layout"))
    monkeypatch.setattr(run, "_write", lambda rows, *_: (rows, {0: np.eye(2)}, {0: 0.0}))
    for m in range(3):
        run.start(m, 6)
    for n in range(3):
        raw = run.update(n)[0].raw
        with co_located(spark):
            found = paths_to_cells(raw._jdf.queryExecution().executedPlan())
        assert len(found) == 1
        path = list(found[0])
        moved = [k for k, name in enumerate(path) if name.startswith("Exchange")]
        # Only what is summed up already moves: one exchange, with the partial sums below it.
        assert len(moved) == 1, path
        assert any(name.startswith("HashAggregate") for name in path[moved[0] :]), path
        assert sum(name.startswith("ShuffledHashJoin") for name in path) == 2, path
    assert spark.conf.get(CO_PARTITION, "true") == "true"
    run.drop()
    assert not spark.catalog.tableExists(run.layout.name.removeprefix("spark_catalog."))


@pytest.mark.parametrize("modes", [(0,), (0, 1), (0, 1, 2)])
def test_every_cell_meets_its_row_once(spark, modes):
    rows, cells = skewed_cells(spark)
    heavy = {m: heavy_keys(cells, mode_col(m)) for m in modes}
    layout = BlockLayout(cells, (40, 30, 20), heavy, new_folder(spark, "layout"))
    assert sorted(map(tuple, layout.cells.drop("block").collect())) == sorted(rows)
    for m in modes:
        table = spark.range((40, 30, 20)[m]).selectExpr(f"id as {mode_col(m)}", "id * 10 as ten")
        met = layout.attach(layout.cells, m, table, "inner")
        with co_located(spark):
            got = sorted((r.i0, r.i1, r.i2, r.value, r.ten) for r in met.collect())
        assert got == sorted((*r, 10 * r[m]) for r in rows)
        sent = layout.send(m, table).groupBy(mode_col(m)).count().collect()
        assert min(r["count"] for r in sent) == layout.blocks // layout.parts[m]
    blocks = layout.cells.where("i0 = 7").agg(F.countDistinct("block")).first()[0]
    assert blocks > layout.blocks / 2  # the heavy index is spread
    layout.drop()


def test_parts_follow_the_extents():
    assert deal_parts([1000, 10], 16) == [16, 1]
    assert deal_parts([64, 64], 16) == [4, 4]
    assert deal_parts([5], 6) == [8]


def test_als_is_the_same_with_and_without_blocks(spark, request):
    rows, cells = skewed_cells(spark)
    from gridloom.tensor import TensorFrame

    tensor = TensorFrame(cells, (40, 30, 20), unique=True)
    trace, wide = [], []
    plain = cp.cp_als(tensor, rank=2, max_iter=3, tol=0.0, trace=trace)
    expected = [factor(f, n, 2) for f, n in zip(plain.factors, plain.shape, strict=True)]
    request.getfixturevalue("shuffled")
    model = cp.cp_als(tensor, rank=2, max_iter=3, tol=0.0, trace=wide)
    assert np.allclose(trace, wide)
    for f, want, n in zip(model.factors, expected, model.shape, strict=True):
        assert np.allclose(factor(f, n, 2), want)
    new, lam = cp.update_factor(tensor, model, 1)
    assert np.allclose(np.linalg.norm(factor(new, 30, 2), axis=0), 1.0) and len(lam) == 2
