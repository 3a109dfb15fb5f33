"""Exact duplicates by two passes over a Bloom filter.

The first pass finds which places of the filter are hit at least twice; the second asks for
every hash whether all its places are such.  Hashes that fail stand for one row each and pass
straight through with a group of their own; only possibly repeated rows are shuffled, grouped
and joined.  A false alarm costs a row's shuffle and changes nothing.

The filter has 16 places a row, a power of two, up to ``MOST_PLACES`` (32 MB of bits, which is
the bound of what is broadcast).  Beyond 16 million rows more rows raise false alarms and are
grouped like any other; results are the same at every size.

Defined cases: null texts count as empty; an empty table gives an empty table; null ids come
last among equals; rows that agree in everything stay one group of which one row is kept;
other columns pass through ``exact_dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

PROBES = 2
LEAST_PLACES, MOST_PLACES = 1 << 16, 1 << 28
PLACES_PER_ROW = 16


def normalised(text: Column) -> Column:
    """Text without ASCII white space."""
    return F.regexp_replace(common.text_or_empty(text), rf"{common.BLANK}+", "")


def _places(key: Column, places: int) -> list[Column]:
    """Places of a key in the filter."""
    return [F.xxhash64(key, F.lit(probe)).bitwiseAND(F.lit(places - 1)) for probe in range(PROBES)]


def repeated_filter(keys: DataFrame, key: str, places: int) -> np.ndarray:
    """First pass: bits of the places that two or more rows hit, at most ``MOST_PLACES``.

    Places are counted with a partial count on the map side, so a hash that a third of all
    rows share arrives as one row per task.  Only words of 64 places that have a bit set come
    to the driver: no more than ``MOST_PLACES`` / 64 of them.
    """
    hit = keys.select(F.explode(F.array_distinct(F.array(*_places(F.col(key), places)))).alias("place"))
    twice = hit.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    words = twice.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(places // 64, dtype=np.int64)
    found = words.toArrow()
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table


def possibly_repeated(keys: DataFrame, key: str, bits: np.ndarray) -> Column:
    """Second pass: a boolean column that is false only for keys that occur once."""
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def all_hit(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        table = shared.value
        for series in batches:
            hit = np.ones(len(series[0]), dtype=bool)
            for place in series:
                at = place.to_numpy()
                hit &= (table[at >> 6] >> (at & 63)) & 1 == 1
            yield pd.Series(hit)

    return all_hit(*_places(F.col(key), len(bits) * 64))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Of equal texts the one with the most code points before normalisation stays, then the one
    with the smallest id; of rows that agree in both, one.
    """
    digest = docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256"),
        F.char_length(common.text_or_empty(text_col)).cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = common.put(digest, "digests")
    count = rows.count()
    places = min(MOST_PLACES, max(LEAST_PLACES, 1 << (PLACES_PER_ROW * max(count, 1) - 1).bit_length()))
    bits = repeated_filter(rows, "text_sha256", places)
    asked = common.put(rows.withColumn("asked", possibly_repeated(rows, "text_sha256", bits)), "asked")
    once = asked.where("NOT asked").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    again = asked.where("asked").drop("asked")
    # Largest first: the longest text, then the smallest id (null last), then the first row.
    rank = F.struct("chars", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("id"), (-F.col("row")).alias("row"))
    groups = common.put(
        again.groupBy("text_sha256").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size")).select(
            "text_sha256", (-F.col("best.id")).alias("keep_id"), (-F.col("best.row")).alias("keep_row"), "group_size"
        ),
        "groups",
    )
    met = common.lookup(again, groups, "text_sha256", "group_size")
    several = met.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
    return once.unionByName(several)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Rows whose hash cannot repeat pass straight from the scan to the result.  The others carry
    their columns into one grouping by hash, where a partial maximum on the map side leaves one
    row per hash and task.
    """
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(
        row.alias("_row"), sha.alias("_sha"), F.char_length(common.text_or_empty(text_col)).alias("_chars"),
        F.col(id_col).alias("_id"),
    )
    hashes = common.put(keyed.select("_sha"), "hashes")
    places = min(MOST_PLACES, max(LEAST_PLACES, 1 << (PLACES_PER_ROW * max(hashes.count(), 1) - 1).bit_length()))
    asked = possibly_repeated(keyed, "_sha", repeated_filter(hashes, "_sha", places))
    marked = keyed.withColumn("_asked", asked)
    order = F.struct("_chars", F.col("_id").isNotNull(), -F.col("_id"), F.xxhash64("_row"))
    best = marked.where("_asked").groupBy("_sha").agg(F.max_by("_row", order).alias("_row"))
    return marked.where("NOT _asked").select("_row.*").unionByName(best.select("_row.*"))
