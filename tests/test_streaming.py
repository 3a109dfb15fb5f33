"""The streamed step: same result as by hand, replays, rows that cannot be placed."""

import numpy as np
import pytest
from dense_tools import dense, factor
from pyspark.sql import functions as F

from gridloom.model import make_model
from gridloom.plans.incremental import incremental_step, start_state
from gridloom.sources import random_factors, slice_window
from gridloom.streaming.slices import (
    _stored_cells,
    apply_batch,
    compact,
    init_state,
    load_state,
    read_commit,
    retire_versions,
    stream_decompose,
)
from gridloom.tensor import TensorFrame

STEP = {"factor": 2, "reps": 1, "max_iter": 2, "tol": 1e-6}
CELLS = "i0 bigint, i1 bigint, i2 bigint, value double"


@pytest.fixture
def case(spark, tensor):
    x = np.random.default_rng(0).random((6, 5, 8))
    t = tensor(x)
    old = slice_window(t, 2, 0, 4)
    tables = random_factors(spark, old.shape, 2, seed=1)
    return x, t, old, make_model(tables, old.shape, 2)


def snapshot(state):
    table = {(r.mode, r.idx): tuple(r.vec) for r in state.model.table().collect()}
    weights = {(r.mode, r.idx): r.w for r in state.weights.collect()}
    return table, weights, sorted(map(tuple, state.tensor.frame.collect()))


def test_stream_equals_steps_by_hand(spark, case, tmp_path):
    x, t, old, model = case
    path = str(tmp_path / "state")
    init_state(path, old, model)
    for low in (4, 6):
        rows = t.frame.where(f"i2 >= {low} and i2 < {low + 2}")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "slices"))
    stream = (
        spark.readStream.schema(CELLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "slices"))
    )
    stream_decompose(stream, path, str(tmp_path / "progress"), 2, **STEP).awaitTermination()
    state = load_state(spark, path)
    by_hand = start_state(old, model)
    for low in (4, 6):
        by_hand = incremental_step(by_hand, slice_window(t, 2, low, low + 2), 2, **STEP)
    assert state.tensor.shape == x.shape
    assert np.array_equal(dense(state.tensor), x)
    for m, n in enumerate(x.shape):
        assert np.allclose(factor(state.model.factors[m], n, 2), factor(by_hand.model.factors[m], n, 2))


def test_replay_changes_nothing_and_a_torn_batch_is_done_again(spark, case, tmp_path):
    x, t, old, model = case
    path = str(tmp_path / "state")
    init_state(path, old, model)
    rows = t.frame.where("i2 >= 4")
    # A batch that died before its commit left half its parts behind.
    rows.limit(3).withColumn("slab", F.col("i2")).write.partitionBy("slab").parquet(f"{path}/cells/version=1")
    (tmp_path / "state" / "commits" / "version=1" / "_temporary").mkdir(parents=True)
    assert load_state(spark, path).tensor.shape == (6, 5, 4)
    assert load_state(spark, path).tensor.nnz() == 6 * 5 * 4
    apply_batch(spark, path, rows, 0, 2, **STEP)
    once = snapshot(load_state(spark, path))
    apply_batch(spark, path, rows, 0, 2, **STEP)
    assert snapshot(load_state(spark, path)) == once
    assert np.array_equal(dense(load_state(spark, path).tensor), x)
    assert load_state(spark, path, 0).tensor.shape == (6, 5, 4)


def test_rows_without_a_place_are_kept_aside(spark, case, tmp_path):
    x, _, old, model = case
    path = str(tmp_path / "state")
    init_state(path, old, model)
    rows = [(0, 0, 3, 1.0), (9, 0, 5, 1.0), (0, None, 5, 1.0), (1, 1, 5, 2.0), (1, 1, 5, 0.5)]
    apply_batch(spark, path, spark.createDataFrame(rows, CELLS), 0, 2, **STEP)
    aside = spark.read.parquet(f"{path}/rejected").collect()
    assert sorted(r.reason for r in aside) == ["missing", "outside"]
    state = load_state(spark, path)
    assert state.tensor.shape == (6, 5, 6)  # slice 4 is empty, slice 5 has one cell
    assert dense(state.tensor)[1, 1, 5] == 2.5
    assert np.isclose(dense(state.tensor)[0, 0, 3], x[0, 0, 3] + 1.0)


def test_slices_in_pieces_and_in_the_wrong_order_lose_nothing(spark, case, tmp_path):
    x, t, old, model = case
    path = str(tmp_path / "state")
    init_state(path, old, model)
    parts = [t.frame.where(w) for w in ("i2 = 5 and i0 < 3", "i2 = 4", "i2 = 5 and i0 >= 3")]
    for batch, rows in enumerate(parts):
        apply_batch(spark, path, rows, batch, 2, **STEP)
    # A stream that is started anew counts its batches from 0 again.
    apply_batch(spark, path, t.frame.where("i2 >= 6"), 0, 2, query="anew", **STEP)
    state = load_state(spark, path)
    assert np.allclose(dense(state.tensor), x)
    weights = {(r.mode, r.idx): r.w for r in state.weights.collect()}
    for m in range(3):
        sums = (x**2).sum(axis=tuple(k for k in range(3) if k != m))
        assert np.allclose([weights[m, i] for i in range(x.shape[m])], sums)
    assert spark.read.parquet(f"{path}/rejected").isEmpty()
    before = snapshot(state)
    retire_versions(spark, path, 1)
    assert snapshot(load_state(spark, path)) == before


def weights_of(x):
    return {(m, i): (x.take(i, m) ** 2).sum() for m in range(x.ndim) for i in range(x.shape[m])}


def spoil(folder, but):
    """Make all data files of the cells but those of some ranges unreadable."""
    spoiled = 0
    for file in (folder / "cells").rglob("part-*.parquet"):
        if file.parent.name not in but:
            file.write_bytes(b"not a table")
            spoiled += 1
    return spoiled


def test_late_rows_read_the_files_of_their_slices_only(spark, case, tmp_path):
    x, _, old, model = case
    path = str(tmp_path / "state")
    init_state(path, old, model, mode=2, width=1)
    assert spoil(tmp_path / "state", {"slab=2"}) >= 3
    late = [(1, 2, 2, 0.5), (1, 2, 2, 0.25), (3, 3, 2, -float(x[3, 3, 2]))]
    apply_batch(spark, path, spark.createDataFrame(late, CELLS), 0, 2, **STEP)
    want = x[:, :, :4].copy()
    want[1, 2, 2] += 0.75
    want[3, 3, 2] = 0.0
    state = load_state(spark, path)
    got = {(r.mode, r.idx): r.w for r in state.weights.collect()}
    assert got.keys() == weights_of(want).keys()
    assert np.allclose([got[k] for k in got], [weights_of(want)[k] for k in got])
    commit = read_commit(spark, path)
    assert {s.slab: (s.files, s.late) for s in commit["slabs"]} == {0: (1, False), 1: (1, False), 2: (2, True), 3: (1, False)}
    # The model has not been fitted anew, so it is still that of version 0.
    assert (commit["weights_at"], commit["factors_at"]) == (1, 0)
    # Compaction reads the one range with late rows, and after it nothing is summed up any more.
    assert compact(spark, path) == 2
    commit = read_commit(spark, path)
    assert not any(s.late for s in commit["slabs"])
    assert {s.slab: s.base for s in commit["slabs"]} == {0: 0, 1: 0, 2: 2, 3: 0}
    assert compact(spark, path) is None
    frame = load_state(spark, path).tensor.frame
    assert "Aggregate" not in frame._jdf.queryExecution().optimizedPlan().toString()
    cells = _stored_cells(spark, path, commit, [2]).drop("slab")
    assert np.allclose(dense(TensorFrame(cells, old.shape))[:, :, 2], want[:, :, 2])


def test_ranges_are_compacted_and_old_files_go(spark, case, tmp_path):
    x, t, old, model = case
    path = str(tmp_path / "state")
    init_state(path, old, model, width=3)
    for batch in range(3):
        rows = t.frame.where("i2 = 1").selectExpr("i0", "i1", "i2", "0.5D as value")
        apply_batch(spark, path, rows, batch, 2, compact_after=3, **STEP)
    apply_batch(spark, path, t.frame.where("i2 >= 4"), 3, 2, compact_after=3, **STEP)
    want = x.copy()
    want[:, :, 1] += 1.5
    commit = read_commit(spark, path)
    # Three versions had added to the first range after the second batch: version 3 compacted it.
    assert [s.base for s in commit["slabs"]] == [3, 0, 0]
    assert [(s.files, s.late) for s in commit["slabs"]] == [(2, True), (2, False), (1, False)]
    state = load_state(spark, path)
    assert np.allclose(dense(state.tensor), want)
    weights = {(r.mode, r.idx): r.w for r in state.weights.collect()}
    assert np.allclose([weights[k] for k in sorted(weights)], [weights_of(want)[k] for k in sorted(weights)])
    before = snapshot(state)
    compact(spark, path)
    assert np.allclose(dense(load_state(spark, path).tensor), want)
    retire_versions(spark, path, 1)
    left = sorted(f.parent.relative_to(tmp_path / "state" / "cells").as_posix() for f in (tmp_path / "state" / "cells").rglob("part-*.parquet"))
    last = read_commit(spark, path)["version"]
    assert set(left) == {f"version={last}/slab=0", f"version={last}/slab=1", f"version={last - 1}/slab=2"}
    table, weights, cells = snapshot(load_state(spark, path))
    assert (table, weights) == before[:2]
    with pytest.raises(LookupError):
        load_state(spark, path, 0)
    # Replays are known from the newest commit alone.
    apply_batch(spark, path, t.frame.where("i2 >= 4"), 3, 2, **STEP)
    assert read_commit(spark, path)["version"] == last


def test_the_growing_mode_is_fixed(spark, case, tmp_path):
    _, t, old, model = case
    path = str(tmp_path / "state")
    init_state(path, old, model)
    with pytest.raises(ValueError, match="grows on mode 2"):
        apply_batch(spark, path, t.frame, 0, 1, **STEP)
