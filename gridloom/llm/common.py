"""What the operators share: names that cannot clash, tables cut off from their plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.joins import salted_join
from gridloom.plans.materialize import shared_dir

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of at most so many bytes, as counted, are broadcast.
BROADCAST_BYTES = 16 << 20
#: A key with more than one part in so many of the rows is spread over salts.
PARTS = 1000

_swept: weakref.WeakSet = weakref.WeakSet()
_shipped: weakref.WeakSet = weakref.WeakSet()


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Spark send this package to the executors, whose Python may not have it."""
    context = spark.sparkContext
    if context in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()).resolve() / "gridloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context)


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path no other table has. All of them go when the application ends, or at ``drop_scratch``."""
    context = spark.sparkContext
    if context not in _swept:
        _swept.add(context)
        atexit.register(drop_scratch, spark)
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    at.getFileSystem(conf).delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every table the operators of this application have put aside."""
    if spark.sparkContext._jsc is not None:
        delete(spark, scratch_root(spark))


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of a query when it has ended, not when the driver happens to
    collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def put(frame: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and go on from its files."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    with _shuffles_removed(spark):
        frame.write.parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.scratch_path = path
    return table


def drop(table: DataFrame) -> None:
    """Remove a table of ``put`` that nothing will read again."""
    delete(table.sparkSession, table.scratch_path)


def own(frame: DataFrame, label: str) -> str:
    """A column name the frame does not have."""
    taken = {name.lower() for name in frame.columns}
    name = f"_{label}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def heavy_of(counts: DataFrame, key: str, n: str, parts: int = PARTS) -> DataFrame:
    """From one row per key with its row count: the fewer than ``parts`` keys that need salts."""
    cut = counts.agg(F.greatest(F.sum(n) / F.lit(parts), F.lit(5000.0)).alias("cut"))
    copies = F.ceil(F.col(n) / cut.scalar())
    return counts.select(key, copies.cast("int").alias("_copies")).where("_copies > 1")


def lookup(members: DataFrame, table: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """Join many rows with one row per key; keys that hold many rows are spread over salts."""
    return salted_join(members, table, key, how, heavy=heavy_of(table, key, n))


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: Column | str) -> Column:
    """How many runs of non-blank characters a text has; null has none."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("bigint")
