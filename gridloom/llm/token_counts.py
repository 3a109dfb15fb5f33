"""Token counts of documents in flat, unindexed token files.

A file is nothing but 16-bit ids, documents one after another, each ended by a separator id.
Files are cut into blocks; in each block the separators are found by one vectorised search,
and what a block cannot know by itself - how many documents ended before it and where the open
one began - comes from a prefix scan over the blocks of its file.  A document may span any
number of blocks.

Defined cases: a file without ids has no documents; ids after the last separator are a last
document that is not ``ended``; a file of an odd number of bytes fails.  ``write_flat`` takes
null and empty texts as documents of no ids, and an empty table gives no documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import common, tokens

#: Ids of the vocabulary stand one higher in the files, so that 0 is free.
SEPARATOR, SHIFT, WIDTH = 0, 1, 2
BLOCK_TOKENS = 1 << 19
FILE_DOCS = 20_000


def write_flat(docs: DataFrame, text_col: str, path: str, vocabulary: str, file_docs: int = FILE_DOCS) -> None:
    """Tokenize texts into flat files under ``path``.

    Spark's text writer puts the bytes of each row and then its line separator, which is the
    separator id: the files hold ids and nothing else, in whatever store the path is.
    """
    ids = tokens.with_ids(docs.select(text_col), text_col, vocabulary, shift=SHIFT)
    separator = np.array([SEPARATOR], dtype="<u2").tobytes().decode("ascii")
    ids.select(F.col("ids").cast("string")).write.option("lineSep", separator).option("compression", "none").option(
        "maxRecordsPerFile", file_docs
    ).text(path)


def _separators(separator: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for content in batch.column("bytes"):
                ids = np.frombuffer(content.as_buffer(), dtype="<u2")
                found.append(np.flatnonzero(ids == separator).astype(np.int64))
                sizes.append(len(ids))
            ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.ListArray.from_arrays(ends, flat), pa.array(sizes, pa.int64())],
                names=["file", "block", "ends", "size"],
            )

    return scan


def token_counts(
    spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """``(file, doc_no, start, n_tokens, ended)`` of every document in the flat files of a folder."""
    common.ship(spark)
    files = spark.read.format("binaryFile").load(path)
    width = block_tokens * WIDTH
    whole = F.when(F.col("length") % WIDTH == 0, F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("odd number of bytes: "), F.col("path"))).cast("bigint")
    )
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(whole - 1, F.lit(0)), F.lit(width).cast("bigint"))
    pieces = F.transform(starts, lambda at: F.substring("content", (at + 1).cast("int"), F.lit(width)))
    cut = (
        files.where("length > 0")
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), pieces.alias("pieces"))
        .select("file", F.posexplode("pieces").alias("block", "bytes"))
        .select("file", F.col("block").cast("bigint").alias("block"), "bytes")
    )
    scanned = cut.mapInArrow(_separators(separator), "file string, block bigint, ends array<bigint>, size bigint")
    offset = F.col("block") * block_tokens
    file = Window.partitionBy("file").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, offset + F.element_at("ends", -1) + 1)
    placed = scanned.select(
        "file", "ends", "size", offset.alias("offset"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs"),
        F.coalesce(F.max(last).over(before), F.lit(0)).alias("open"),
        F.lead("block").over(file).isNull().alias("final"),
    )
    # Ids after the last separator of the file: one more end, past the last id.
    tail = F.col("final") & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("open") - F.col("offset") - 1) < F.col("size") - 1)
    ends = F.when(tail, F.concat("ends", F.array("size"))).otherwise(F.col("ends"))
    spans = placed.select("file", "offset", "docs", "open", "size", ends.alias("ends")).select(
        "*", F.posexplode("ends").alias("k", "end")
    )
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(
        F.col("offset") + F.get("ends", F.col("k") - 1) + 1
    )
    return spans.select(
        "file", (F.col("docs") + F.col("k")).alias("doc_no"), start.alias("start"),
        (F.col("offset") + F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("size")).alias("ended"),
    )


def count_document_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write all texts to flat files in the shared folder and count the tokens of each from there."""
    spark = docs.sparkSession
    path = common.new_path(spark, "flat")
    write_flat(docs, text_col, path, vocabulary or tokens.default_vocabulary())
    return token_counts(spark, path)
