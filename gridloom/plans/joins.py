"""How a big table meets a table keyed by one index.

Two ways, chosen by a checked size:

* the keyed side has a proven row bound and fits ``gridloom.broadcast.maxBytes``
  (64 MiB unless set): broadcast join, the big table is not shuffled;
* otherwise a shuffle join whose heavy keys are spread.  A key is heavy when it
  holds more than one part in ``PARTS`` of the rows, so there are fewer than
  ``PARTS`` of them whatever the data: that list, and nothing else, is broadcast
  to decide how many salts a key gets.  A key with a third of all rows is then
  read by about ``PARTS / 3`` tasks instead of one.

Where both sides hold many rows of a key, what counts is the pairs they make: a key with
more than one part in ``PARTS`` of all pairs, and more than ``LEAST_PAIRS``, is shared out on a
grid, rows of one side along its lines and rows of the other along its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_CONF = "gridloom.broadcast.maxBytes"
BROADCAST_BYTES = 64 << 20
PARTS = 1000
# Pairs of one key that a task may always make.
LEAST_PAIRS = 1 << 20


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_CONF, str(BROADCAST_BYTES)))


def fits_broadcast(spark: SparkSession, rows: int | None, row_bytes: int) -> bool:
    return rows is not None and rows * row_bytes <= broadcast_limit(spark)


def heavy_pairs(left: DataFrame, right: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """Keys that make many pairs, with the grid ``_p`` by ``_q`` their pairs are shared out on.

    A row of the left side goes to one line of the grid and all its ``_q`` cells, a row of the
    right side to one column and all its ``_p`` cells, so each pair meets in one cell.  The grid
    is as oblong as the sides are: ``l * q + r * p`` rows travel, about twice the root of
    ``cells * l * r``, which grows with the root of the number of cells.
    """
    rows = left.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("_l")).join(
        right.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("_r")), key
    )
    pairs = F.col("_l") * F.col("_r")
    cut = rows.agg(F.greatest(F.sum(pairs) / F.lit(parts), F.lit(float(LEAST_PAIRS))).alias("cut"))
    found = rows.withColumn("_cells", F.ceil(pairs / cut.scalar())).where("_cells > 1")
    lines = F.greatest(F.lit(1.0), F.least(F.col("_cells"), F.round(F.sqrt(F.col("_cells") * F.col("_l") / F.col("_r")))))
    return found.withColumn("_p", lines.cast("int")).select(
        key, "_p", F.ceil(F.col("_cells") / F.col("_p")).cast("int").alias("_q")
    )


def _pair_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    heavy = heavy_pairs(left, right, key)

    def dealt(side: DataFrame, own: str, other: str, step: str, across: str) -> DataFrame:
        # A line of the side's own axis by a hash of its whole-number columns, and every
        # cell along it.
        fixed = [name for name, kind in side.dtypes if kind in ("bigint", "int")]
        line = F.pmod(F.xxhash64(*fixed), F.coalesce(own, F.lit(1))).cast("int")
        cells = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        return (
            side.join(F.broadcast(heavy), key, "left")
            .withColumn("_line", line)
            .withColumn("_cell", F.explode(cells))
            .withColumn("_salt", F.expr(f"_line * coalesce({step}, 1) + _cell * coalesce({across}, 1)"))
            .drop("_p", "_q", "_line", "_cell")
        )

    # Rows of both sides multiply: small as the sides may be, the pairs are shared
    # out by key and salt, not made where the scan of one side happens to run.
    copied = dealt(right, "_q", "_p", "1", "_q").hint("merge")
    return dealt(left, "_p", "_q", "_q", "1").join(copied, [key, "_salt"], how).drop("_salt")


def heavy_keys(frame: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """Keys above one part in ``parts`` of the rows, with the salts they need."""
    counts = frame.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    cut = counts.agg((F.sum("_n") / F.lit(parts)).alias("cut"))
    share = F.col("_n") / cut.scalar()
    return counts.select(key, share.alias("_share")).where("_share > 1").select(
        key, F.ceil("_share").cast("int").alias("_copies")
    )


def _spread(frame: DataFrame, key: str, heavy: DataFrame, salt: str) -> DataFrame:
    """Give each row of a heavy key one of its salts, by a hash of its whole-number columns.

    Sums of doubles are left out of the hash: they can come out a little different
    when a lost task is run again, and the row must then still get the same salt.
    """
    fixed = [name for name, kind in frame.dtypes if kind in ("bigint", "int")]
    pick = F.pmod(F.xxhash64(*fixed), F.col("_copies")).cast("int")
    return (
        frame.join(F.broadcast(heavy), key, "left")
        .withColumn(salt, F.coalesce(pick, F.lit(0)))
        .drop("_copies")
    )


def _replicate(frame: DataFrame, key: str, heavy: DataFrame, salt: str) -> DataFrame:
    """One copy of each row per salt of its key."""
    last = F.coalesce(F.col("_copies") - 1, F.lit(0))
    return (
        frame.join(F.broadcast(heavy), key, "left")
        .withColumn(salt, F.explode(F.sequence(F.lit(0), last)))
        .drop("_copies")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    right_unique: bool = True,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Equi-join on ``key`` with the heavy keys of both sides spread.

    ``right_unique``: the right side has one row per key, so it needs no
    spreading itself and a left join is allowed; ``heavy`` may then hand in the
    heavy keys of the left side when they are already known.
    """
    if how == "left" and not right_unique:
        raise ValueError("a left join needs a right side with unique keys")
    if not right_unique:
        return _pair_join(left, right, key, how)
    heavy_left = heavy_keys(left, key) if heavy is None else heavy
    spread_left = _spread(left, key, heavy_left, "_salt")
    copied_right = _replicate(right, key, heavy_left, "_salt")
    return spread_left.join(copied_right, [key, "_salt"], how).drop("_salt")


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    rows: int | None,
    row_bytes: int,
    how: str = "inner",
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` with a table that has at most one row per ``key``.

    ``rows`` is the proven row bound of that table (None when there is none).
    """
    if fits_broadcast(left.sparkSession, rows, row_bytes):
        return left.join(F.broadcast(right), key, how)
    return salted_join(left, right, key, how, heavy=heavy)
