"""The incremental step fed by Structured Streaming.

State is kept in a folder as a log of versions, one per micro-batch or compaction::

    cells/version=K/slab=S   cells added by version K whose slice lies in range S
    weights/version=K        slice weights after version K
    factors/version=K        factor rows after version K
    rejected/version=K       rows batch K could not use, with the reason
    commits/version=K        one row, written last: see ``COMMIT``

The growing mode is cut into ranges of ``width`` slices.  A commit says of every range which
version its files begin with, how many versions have added files since, and whether some of
them came late, that is, for slices that were there.  Cells of late rows are added to what is
stored when the state is read, and only in such ranges; everything else is read as it lies.
A late batch reads the files of its ranges to learn the cells it changes: a cell that goes from
``v`` to ``v + d`` changes its slices' weights by ``2 v d + d * d``.  Ranges with many files are
compacted: their cells are written once more as the range's new beginning.

A version without a commit row does not exist.  A commit keeps the last batch of every query
(their batches count up), so a batch that is replayed finds itself there and does nothing; a
batch that died writes its parts over.  Version 0 is the state the stream starts from; every
other batch makes the version after the last, so a stream that is started anew with another
checkpoint goes on from there.  Only the newest commit is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.model import CPModel
from gridloom.operators.aggregates import slice_weights
from gridloom.plans.incremental import DecompositionState, incremental_step
from gridloom.plans.materialize import Scratch
from gridloom.tensor import TensorFrame, require_same

COMMIT = (
    "version bigint, shape array<bigint>, lam array<double>, mode int, width bigint, weights_at bigint, "
    "factors_at bigint, batches map<string, bigint>, "
    "slabs array<struct<slab: bigint, base: bigint, files: int, late: boolean>>"
)
WEIGHTS = "mode int, idx bigint, w double"
FACTORS = "mode int, idx bigint, vec array<double>"
#: Ranges the growing mode is cut into at the start, about.
RANGES = 256
#: A range that this many versions have added files to is compacted.
COMPACT_AFTER = 8


def _put(frame: DataFrame, path: str, part: str, version: int) -> None:
    frame.write.mode("overwrite").parquet(f"{path}/{part}/version={version}")


def _put_cells(frame: DataFrame, path: str, version: int, mode: int, width: int) -> None:
    """Cells by ranges; Spark sizes the files of a range."""
    rows = frame.withColumn("slab", F.expr(f"i{mode} div {width}L")).hint("rebalance", "slab")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy("slab").parquet(f"{path}/cells/version={version}")


def _commit(spark: SparkSession, path: str, row: dict) -> None:
    kind = COMMIT.removeprefix("version bigint, ")
    names = ["shape", "lam", "mode", "width", "weights_at", "factors_at", "batches", "slabs"]
    values = tuple(list(row[n]) if n in ("shape", "lam", "slabs") else row[n] for n in names)
    _put(spark.createDataFrame([values], kind).coalesce(1), path, "commits", row["version"])


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions in a part of the state, newest first, committed or not."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(folder):
        return []
    names = [status.getPath().getName() for status in store.listStatus(folder)]
    return sorted((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), reverse=True)


def _read_commit(spark: SparkSession, path: str, version: int) -> dict | None:
    kind = COMMIT.removeprefix("version bigint, ")
    row = spark.read.schema(kind).parquet(f"{path}/commits/version={version}").first()
    return None if row is None else {**row.asDict(), "version": version}


def read_commit(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The commit of a version, the newest unless given."""
    found = _versions(spark, f"{path}/commits")
    for v in found if version is None else [v for v in found if v == version]:
        commit = _read_commit(spark, path, v)
        if commit is not None:  # else its writer died
            return commit
    raise LookupError(f"no committed version {version} in {path}")


def init_state(
    path: str, tensor: TensorFrame, model: CPModel, mode: int = -1, width: int | None = None
) -> None:
    """Write version 0: the tensor and model the stream goes on from.  ``mode`` will grow; its
    slices are stored in ranges of ``width``."""
    require_same(tensor.shape, model.shape, "model and tensor differ in shape")
    spark, mode = tensor.spark, mode % tensor.n_modes
    width = width or max(1, -(-tensor.shape[mode] // RANGES))
    _put_cells(tensor.frame, path, 0, mode, width)
    slabs = [_slab(s, 0, 1, not tensor.unique) for s in _slabs_of(spark, path, 0)]
    commit = {
        "version": 0, "shape": tensor.shape, "lam": model.lam, "mode": mode, "width": width, "weights_at": 0,
        "factors_at": 0, "batches": {}, "slabs": slabs,
    }
    _put(slice_weights(_tensor_of(spark, path, commit)), path, "weights", 0)
    _put(model.table(), path, "factors", 0)
    _commit(spark, path, commit)


def _slab(slab: int, base: int, files: int, late: bool) -> Row:
    return Row(slab=slab, base=base, files=files, late=late)


def _slabs_of(spark: SparkSession, path: str, version: int) -> list[int]:
    """Ranges that a version has files of, by the names of their folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cells/version={version}")
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [status.getPath().getName() for status in store.listStatus(folder)]
    return sorted(int(n.removeprefix("slab=")) for n in names if n.startswith("slab="))


def _stored_cells(
    spark: SparkSession, path: str, commit: dict, slabs: Sequence[int] | None = None
) -> DataFrame:
    """Cells of a commit as they are stored, with their range; only files of ``slabs`` if given.
    All conditions are on folders, so no other file is opened."""
    index = ", ".join(f"i{m} bigint" for m in range(len(commit["shape"])))
    frame = spark.read.schema(f"{index}, value double, version bigint, slab bigint").parquet(f"{path}/cells")
    frame = frame.where(F.col("version") <= commit["version"])
    moved = [s for s in commit["slabs"] if s.base > 0]
    if moved:
        bases = ", ".join(f"{s.slab}L, {s.base}L" for s in moved)
        frame = frame.where(f"version >= coalesce(try_element_at(map({bases}), slab), 0L)")
    if slabs is not None:
        frame = frame.where(F.col("slab").isin(list(slabs)))
    return frame.drop("version")


def _summed(cells: DataFrame, index: Sequence[str]) -> DataFrame:
    return cells.groupBy(*index).agg(F.sum("value").alias("value"))


def _unique_cells(spark: SparkSession, path: str, commit: dict) -> DataFrame:
    """Cells of a commit, those of ranges with late rows summed up."""
    index = [f"i{m}" for m in range(len(commit["shape"]))]
    stored = _stored_cells(spark, path, commit)
    late = [s.slab for s in commit["slabs"] if s.late]
    if not late:
        return stored.select(*index, "value")
    touched = F.col("slab").isin(late)
    return stored.where(~touched).select(*index, "value").unionByName(_summed(stored.where(touched), index))


def _tensor_of(spark: SparkSession, path: str, commit: dict) -> TensorFrame:
    clean = not any(s.late for s in commit["slabs"])
    return TensorFrame(_unique_cells(spark, path, commit), tuple(commit["shape"]), unique=True, stored=clean)


def load_state(spark: SparkSession, path: str, version: int | None = None) -> DecompositionState:
    """The state of a version, the latest committed one unless given."""
    return _state_of(spark, path, read_commit(spark, path, version))


def _state_of(spark: SparkSession, path: str, commit: dict) -> DecompositionState:
    weights = spark.read.schema(WEIGHTS).parquet(f"{path}/weights/version={commit['weights_at']}")
    table = spark.read.schema(FACTORS).parquet(f"{path}/factors/version={commit['factors_at']}")
    model = CPModel.from_table(table, commit["lam"], tuple(commit["shape"]))
    return DecompositionState(_tensor_of(spark, path, commit), weights, model)


def _sort_out(rows: DataFrame, shape, mode: int) -> DataFrame:
    """Why a row cannot be placed; null for a good one."""
    n_modes = len(shape)
    fields = [f"i{m}" for m in range(n_modes)]
    missing = " or ".join(f"{c} is null" for c in [*fields, "value"])
    outside = " or ".join(
        f"not {c} between 0 and {n - 1}" for m, (c, n) in enumerate(zip(fields, shape, strict=True)) if m != mode
    )
    return rows.withColumn(
        "reason",
        F.expr(
            f"case when {missing} then 'missing' "
            f"when {outside} or i{mode} < 0 then 'outside' end"
        ),
    )


def late_weights(weights: DataFrame, changes: DataFrame, stored: DataFrame, index: Sequence[str]) -> DataFrame:
    """Slice weights after cells have changed by the values in ``changes`` (one row a cell);
    ``stored`` has the cells before, repeated ones to be summed, of the same ranges at least."""
    cells = changes.select(*index, F.col("value").alias("d"))
    before = _summed(stored.join(cells, list(index), "left_semi"), index).withColumnRenamed("value", "v")
    change = F.expr("2 * coalesce(v, 0D) * d + d * d")
    places = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(c).alias("idx")) for m, c in enumerate(index)])
    moved = cells.join(before, list(index), "left").select(F.explode(places).alias("at"), change.alias("w"))
    both = weights.select("mode", "idx", "w").unionByName(moved.select("at.mode", "at.idx", "w"))
    # Rounding must not make a weight negative.
    return both.groupBy("mode", "idx").agg(F.greatest(F.sum("w"), F.lit(0.0)).alias("w"))


def _grown_slabs(slabs: Sequence[Row], added: Sequence[int], late: Sequence[int]) -> list[Row]:
    """The ranges after a version has added files to some of them."""
    known = {s.slab: s for s in slabs}
    for s in added:
        old = known.get(s)
        known[s] = _slab(s, old.base if old else 0, (old.files if old else 0) + 1, bool(old and old.late) or s in late)
    return [known[s] for s in sorted(known)]


def apply_batch(
    spark: SparkSession, path: str, rows: DataFrame, batch_id: int, mode: int, query: str = "",
    compact_after: int = COMPACT_AFTER, **step
) -> None:
    """One micro-batch: rows ``(i0.., value)`` with the index on ``mode`` counted from
    the start of the stream.  Rows from the current extent on are new slices; rows before
    it are added to the slices that are there; rows with nulls or outside the other extents
    have no place and are kept aside.  Ranges that ``compact_after`` versions have added to
    are compacted afterwards."""
    last = read_commit(spark, path)
    if last["batches"].get(query, -1) >= batch_id:
        return
    shape, width = tuple(last["shape"]), last["width"]
    mode %= len(shape)
    if mode != last["mode"]:
        raise ValueError(f"the state grows on mode {last['mode']}, not on {mode}")
    version, low = last["version"] + 1, shape[mode]
    index = [f"i{m}" for m in range(len(shape))]
    scratch = Scratch(spark, "batch")
    sorted_rows = _sort_out(rows, shape, mode).persist()
    try:
        _put(sorted_rows.where("reason is not null"), path, "rejected", version)
        good = sorted_rows.where("reason is null").drop("reason")
        _put_cells(_summed(good.withColumn("value", F.col("value").cast("double")), index), path, version, mode, width)
        added = _slabs_of(spark, path, version)
        schema = ", ".join(f"{c} bigint" for c in index) + ", value double, slab bigint"
        fresh = spark.read.schema(schema).parquet(f"{path}/cells/version={version}")
        known = fresh.where(F.col(f"i{mode}") < low)
        late = [s for s in added if s * width < low]
        late = [r.slab for r in known.where(F.col("slab").isin(late)).select("slab").distinct().collect()] if late else []
        commit = {
            **last, "version": version, "batches": {**last["batches"], query: batch_id},
            "slabs": _grown_slabs(last["slabs"], added, late),
        }
        state = _state_of(spark, path, last)
        if late:
            weights = late_weights(state.weights, known.select(*index, "value"), _stored_cells(spark, path, last, late), index)
            seen = TensorFrame(
                _unique_cells(spark, path, commit).where(F.col(f"i{mode}") < low), shape, unique=True
            )
            state = DecompositionState(seen, scratch.stage(weights, "weights"), state.model)
            _put(state.weights, path, "weights", version)
            commit["weights_at"] = version
        top = fresh.where(F.col(f"i{mode}") >= low).agg(F.max(f"i{mode}").alias("top")).first().top
        if top is not None:
            extents = shape[:mode] + (top + 1 - low,) + shape[mode + 1 :]
            moved = fresh.where(F.col(f"i{mode}") >= low).select(*index, "value").withColumn(
                f"i{mode}", F.col(f"i{mode}") - F.lit(low).cast("bigint")
            )
            new = TensorFrame(moved, extents, unique=True, stored=True)
            grown = incremental_step(state, new, mode, scratch=scratch, **step)
            _put(grown.weights, path, "weights", version)
            _put(grown.model.table(), path, "factors", version)
            commit |= {
                "shape": grown.tensor.shape, "lam": grown.model.lam, "weights_at": version, "factors_at": version,
            }
        _commit(spark, path, commit)
    finally:
        sorted_rows.unpersist()
        scratch.drop()
    if any(s.files >= compact_after for s in commit["slabs"]):
        compact(spark, path, compact_after)


def compact(spark: SparkSession, path: str, least_files: int = 1) -> int | None:
    """Write ranges that at least so many versions have added files to, or all that have several
    files or late rows, once more: the version made, None if there is nothing to do.  Files of
    other ranges are not read."""
    last = read_commit(spark, path)
    chosen = [s.slab for s in last["slabs"] if (s.files > 1 or s.late) and s.files >= least_files]
    if not chosen:
        return None
    version, index = last["version"] + 1, [f"i{m}" for m in range(len(last["shape"]))]
    cells = _summed(_stored_cells(spark, path, last, chosen), index)
    _put_cells(cells, path, version, last["mode"], last["width"])
    slabs = [_slab(s.slab, version, 1, False) if s.slab in chosen else s for s in last["slabs"]]
    _commit(spark, path, {**last, "version": version, "slabs": slabs})
    return version


def retire_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Keep what the last ``keep`` versions are read from and remove the rest: older commits,
    weights and factors, and files of ranges that have been compacted since."""
    kept = []
    for v in _versions(spark, f"{path}/commits"):
        commit = _read_commit(spark, path, v)
        if commit is not None:
            kept.append(commit)
        if len(kept) == keep:
            break
    oldest = kept[-1]
    base = {s.slab: s.base for s in oldest["slabs"]}
    gone = [f"{path}/commits/version={v}" for v in _versions(spark, f"{path}/commits") if v < oldest["version"]]
    for part in ("weights", "factors"):
        used = {c[f"{part}_at"] for c in kept}
        found = _versions(spark, f"{path}/{part}")
        gone += [f"{path}/{part}/version={v}" for v in found if v <= oldest["version"] and v not in used]
    for v in _versions(spark, f"{path}/cells"):
        if v < oldest["version"]:
            gone += [f"{path}/cells/version={v}/slab={s}" for s in _slabs_of(spark, path, v) if v < base.get(s, 0)]
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for name in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(conf).delete(folder, True)


def stream_decompose(
    slices: DataFrame, state_path: str, checkpoint: str, mode: int, **step
) -> StreamingQuery:
    """Run the incremental step on every micro-batch of a streaming table of cells.

    ``slices`` is a stream ``(i0.., value)``; everything available is worked off and
    the query ends.  ``step`` goes to ``incremental_step``.
    """

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        apply_batch(spark, state_path, rows, batch_id, mode, query, **step)

    return (
        slices.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
