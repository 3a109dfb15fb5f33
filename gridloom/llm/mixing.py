"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the documents stand in the order
of their keys, cut into ranges of keys; sums of the ranges give the words before each range
and a running sum inside a range gives the words before each document, so a source of any
size is ordered by many tasks.  A source's budget takes its documents in that order, once or
several times over, and ends exactly where the budget ends, inside a document if need be.

Defined cases: a null text has size 0; null is a source of its own, last in the order; a
source without words has target 0; rows that agree in id, source and size follow each other
in any order (they are the same to the result).  An empty table gives an empty table.  Other
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Hexadecimal digits of a key that name its range: 4096 ranges in a source.
RANGE_DIGITS = 3


def mix_key(doc_id: Column, source: Column, size: Column, seed: str = SEED) -> Column:
    """Random key of a document: the same in every run."""
    parts = [F.lit(seed)] + [F.coalesce(c.cast("string"), F.lit("null")) for c in (doc_id, source, size)]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def source_targets(
    totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``(source, source_size)`` with ``target``: weights in turn by source name, targets filled
    up to ``most`` times the size, what is over shared among the rest by weight.

    The level of the filling is found from sums in the order of limit / weight, so no rounds
    are needed.  One row per source: the windows see sources, not documents.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))
    first = totals.withColumn(
        "weight", F.get(turn, F.pmod(F.row_number().over(names) - 1, F.lit(len(weights)))).cast("double")
    ).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    below = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy()
    size = F.sum("source_size").over(whole) * F.lit(float(share))
    filled = F.coalesce(F.sum("limit").over(below), F.lit(0.0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    leveled = first.withColumn("_level", (size - filled) / weight)
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("limit"), F.col("_level"))
    return leveled.withColumn("_fill", F.max(fits).over(whole)).select(
        "source",
        "source_size",
        F.when(F.col("_fill").isNull(), F.col("limit"))
        .otherwise(F.least("limit", F.col("_fill") * F.col("weight")))
        .alias("target"),
    )


def mix_marks(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size_col: str | None = None,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """All rows and columns of ``docs`` and, last, one struct column ``_mix`` (size, source_size,
    target, taken): the words the mix takes of each document, repeats counted.

    ``size_col`` names the size if it is known; else the words of the text are counted.
    """
    mark = common.own(docs, "mix")
    source = F.col(source_col)
    size = F.col(size_col) if size_col else common.word_count(text_col)
    key = mix_key(F.col(id_col), F.col("source"), F.col("size"), seed)
    sized = docs.select(F.col(id_col), source.alias("source"), size.alias("size"))
    narrow = common.put(
        sized.groupBy("source", F.substring(key, 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("size")),
        "mix-ranges",
    )
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = narrow.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    ranges = ranges.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source")).select(
        F.struct(F.col("r.source").alias("source"), "range", "before", "source_size", "target").alias("_range")
    )
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        size.alias("_size"), source.alias("_source"), F.col(id_col).alias("_id"),
    ).withColumn("_key", mix_key(F.col("_id"), F.col("_source"), F.col("_size"), seed))
    keyed = keyed.withColumn("_part", F.substring("_key", 1, RANGE_DIGITS))
    inside = Window.partitionBy("_source", "_part").orderBy("_key", "_id", "_size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    met = placed.join(ranges, F.expr("_source <=> _range.source AND _part = _range.range"))
    total, budget = F.col("_range.source_size"), F.floor("_range.target")
    epochs = F.when(total > 0, F.floor(budget / total)).otherwise(F.lit(0))
    rest = budget - epochs * total - F.col("_range.before") - F.col("_inside")
    taken = epochs * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), rest))
    return met.select(
        "_row.*",
        F.struct(
            F.col("_size").alias("size"), total.alias("source_size"),
            F.col("_range.target").alias("target"), taken.cast("bigint").alias("taken"),
        ).alias(mark),
    )


def mix_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document stands once for each epoch that
    takes it; the one in which a budget ends keeps the words up to there, and documents of which
    nothing is taken go.  Documents without words weigh nothing and stay once.
    """
    marks = mix_marks(docs, text_col=text_col, **options)
    mark = marks.columns[-1]
    size, taken = F.col(mark)["size"], F.col(mark)["taken"]
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(F.lit(1)).cast("int")
    turn = common.own(marks, "turn")
    rows = marks.where(copies > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(size, taken - (F.col(turn) - 1) * size)
    kept = F.when(words < size, _first_words(F.col(text_col), words)).otherwise(F.col(text_col))
    return rows.withColumn(text_col, kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def _first_words(text: Column, words: Column) -> Column:
    """The first words of a text, one blank between them."""
    found = F.regexp_extract_all(text, F.lit(f"({common.WORD})"), F.lit(1))
    return F.array_join(F.slice(found, F.lit(1), words.cast("int")), " ")
