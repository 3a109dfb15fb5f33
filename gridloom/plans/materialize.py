"""Cutting lineage in storage that outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode one is made if none is set."""
    context = spark.sparkContext
    given = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        given = tempfile.mkdtemp(prefix="gridloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(given)
    return given


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"


def put(frame: DataFrame, path: str) -> DataFrame:
    """Write a table as Parquet, over what is there, and go on from the files.

    Unlike a checkpointed plan the files carry nothing of the query that made
    them, so plans of an iteration stay the same size from round to round.
    """
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def put_and_measure(frame: DataFrame, path: str, sums: list[Column]) -> tuple[DataFrame, dict]:
    """``put``, with aggregates of the rows taken by the writing tasks themselves, so
    that the files need not be read for them.  Only tasks that commit are counted."""
    seen = Observation(uuid.uuid4().hex)
    return put(frame.observe(seen, *sums), path), seen.get


def stage(frame: DataFrame, label: str) -> DataFrame:
    """``put`` into a new folder: for what is read again and again."""
    return put(frame, new_folder(frame.sparkSession, label))


class Scratch:
    """A folder for tables that are done with when a piece of work ends.

    ``with Scratch(spark, label) as scratch`` removes it at the end; nothing that is
    read later may depend on it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = new_folder(spark, label)
        self._tables = 0

    def stage(self, frame: DataFrame, label: str) -> DataFrame:
        self._tables += 1
        return put(frame, f"{self.folder}/{self._tables}-{label}")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        path.getFileSystem(conf).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()
