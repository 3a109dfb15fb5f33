"""Connected components of links, by contraction.

Every round gives each node the smallest id among itself and its neighbours, follows that
pointer twice more, and goes on with the links between the ids so found, which are fewer by
half at least.  Rounds are tables in the shared folder; nothing is brought to the driver but
a count.  Links of one task are first replaced by a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.plans.joins import salted_join


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node each is joined with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, root = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        other = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(root[other]), pa.array(nodes[other])], names=["a", "b"])


def attach(members: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join members with one row per key; keys that hold many members are spread over salts."""
    heavy = common.heavy_of(members.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "n")
    return salted_join(members, table, key, how, heavy=heavy)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node with a link; ``links`` has bigint columns a and b."""

    common.ship(links.sparkSession)

    def step(edges: DataFrame) -> DataFrame:
        clean = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return common.put(clean.distinct().mapInArrow(_forest, "a bigint, b bigint"), "links")

    edges, levels = step(links), []
    while not edges.isEmpty():
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        level = common.put(lowest.select("node", F.least("node", "low").alias("to")), "level")
        for _ in range(2):
            onward = level.select(F.col("node").alias("to"), F.col("to").alias("next"))
            level = common.put(
                attach(level, onward, "to").select("node", F.coalesce("next", "to").alias("to")), "level"
            )
        levels.append(level)
        first = attach(edges, level.select(F.col("node").alias("a"), F.col("to").alias("low")), "a", "inner")
        both = attach(
            first.select("b", "low"), level.select(F.col("node").alias("b"), F.col("to").alias("high")), "b", "inner"
        ).select(F.col("low").alias("a"), F.col("high").alias("b"))
        chain = level.select("to").distinct().join(level.withColumnRenamed("to", "next"), F.col("to") == F.col("node"))
        edges = step(both.unionByName(chain.select(F.col("to").alias("a"), F.col("next").alias("b"))))
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = levels[-1]
    for level in reversed(levels[:-1]):
        onward = found.select(F.col("node").alias("to"), F.col("to").alias("next"))
        found = attach(level, onward, "to").select("node", F.coalesce("next", "to").alias("to"))
    return found.select("node", F.col("to").alias("component"))
