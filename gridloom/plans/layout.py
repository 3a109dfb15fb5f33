"""Cells laid out once so that factor rows come to them, sweep after sweep.

A factor that is too long to broadcast has to meet the cells in a shuffle join.  If the cells
moved for that, every update of every sweep would shuffle all of them, once per long mode.
Instead they are written once as a bucketed table: the indexes of each long mode are dealt into
parts by a hash, a cell's parts on all long modes are its block, and a block lies in one
bucket.  An update then sends each factor row to the blocks of its part, joins there, and
sends back one partial sum per index and task.  Cells never move again.

With ``B`` blocks, of which ``p`` parts on a mode, a factor row of that mode is sent ``B / p``
times.  Parts are dealt out so that the longest mode has most of them, which keeps the rows
sent, the sum of ``extent * B / p`` over the modes, about as low as it can be.

An index that holds more cells than a part should (or a thousandth of all, if that is more)
would fill its part.  Its cells are dealt over all parts by a hash of the whole coordinate and
its factor row goes to every block; there are fewer than a thousand such indexes on a mode.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.joins import PARTS
from gridloom.tensor import Shape, mode_col

#: Cells of a bucket, about.
BUCKET_CELLS = 1 << 22
#: Spark's own bound on buckets of a table.
MOST_BUCKETS = 100_000
#: Blocks a bucket, about: blocks fall into buckets by a hash, and several even that out.
BLOCKS_A_BUCKET = 4
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Lets a join on block and index use buckets, which are by block alone."""
    before = spark.conf.get(CO_PARTITION, "true")
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)


def deal_parts(extents: Sequence[int], blocks: int) -> list[int]:
    """Parts per mode, powers of two with a product of at least ``blocks``: each doubling goes to
    the mode whose parts are longest."""
    parts, made = [1] * len(extents), 1
    while made < blocks:
        longest = max(range(len(extents)), key=lambda k: extents[k] / parts[k])
        parts[longest] *= 2
        made *= 2
    return parts


class BlockLayout:
    """The cells ``(block, i0.., value)`` of a run as a bucketed table.

    ``heavy`` has for each long mode its ``heavy_keys``, in a column called as the mode's.
    """

    def __init__(self, cells: DataFrame, extents: Shape, heavy: dict[int, DataFrame], folder: str):
        spark = cells.sparkSession
        self.spark, self.heavy, self.modes = spark, heavy, sorted(heavy)
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(MOST_BUCKETS, max(partitions, -(-cells.count() // BUCKET_CELLS)))
        parts = deal_parts([extents[m] for m in self.modes], BLOCKS_A_BUCKET * buckets)
        self.parts = dict(zip(self.modes, parts, strict=True))
        self.steps, self.blocks = {}, 1
        for m in reversed(self.modes):
            self.steps[m] = self.blocks
            self.blocks *= self.parts[m]
        self.path = f"{folder}/blocks"
        self.name = f"spark_catalog.default.gridloom_blocks_{uuid.uuid4().hex}"
        self._write(cells, buckets)
        self.cells = spark.table(self.name)

    def _part(self, m: int, index_cols: Sequence[str]) -> str:
        """SQL text of a cell's part on a mode; ``h{m}`` says that its index is heavy."""
        spread = f"xxhash64({', '.join(index_cols)}, {m})"
        return f"pmod(if(h{m}, {spread}, xxhash64({mode_col(m)})), {self.parts[m]}L)"

    def _flagged(self, frame: DataFrame, m: int, flag: str) -> DataFrame:
        filling = self.heavy[m].where(F.col("_copies") * self.parts[m] > PARTS)
        listed = filling.select(mode_col(m), F.lit(True).alias(flag))
        return frame.join(F.broadcast(listed), mode_col(m), "left").withColumn(
            flag, F.coalesce(flag, F.lit(False))
        )

    def _write(self, cells: DataFrame, buckets: int) -> None:
        index_cols = cells.columns[:-1]
        frame = cells
        for m in self.modes:
            frame = self._flagged(frame, m, f"h{m}")
        block = " + ".join(f"{self._part(m, index_cols)} * {self.steps[m]}L" for m in self.modes)
        rows = frame.selectExpr(f"{block} as block", *index_cols, "value")
        # Dealt by what the buckets are made of: one file a bucket.
        dealt = rows.repartition(buckets, "block")
        dealt.write.format("parquet").bucketBy(buckets, "block").option("path", self.path).saveAsTable(self.name)

    def send(self, m: int, rows: DataFrame) -> DataFrame:
        """Factor rows of a mode, ``i{m}`` and more columns, once for each block that needs them."""
        parts, step = self.parts[m], self.steps[m]
        flagged = self._flagged(rows, m, "_all")
        last = f"if(_all, {self.blocks}L, {self.blocks // parts}L) - 1"
        copies = flagged.withColumn("_copy", F.explode(F.expr(f"sequence(0L, {last})")))
        own = f"pmod(xxhash64({mode_col(m)}), {parts}L)"
        of_part = f"(_copy div {step}L) * {step * parts}L + {own} * {step}L + _copy % {step}L"
        return copies.selectExpr(f"if(_all, _copy, {of_part}) as block", *rows.columns)

    def attach(self, frame: DataFrame, m: int, rows: DataFrame, how: str) -> DataFrame:
        """Cells, where they lie, with the factor rows of their index on a mode."""
        return frame.join(self.send(m, rows).hint("shuffle_hash"), ["block", mode_col(m)], how)

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
