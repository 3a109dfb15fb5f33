"""Lining the components of a fresh model up with those of an existing one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import is_zero, ratio, sign_of
from gridloom.model import CPModel
from gridloom.operators.factors import flat_cols, unpack

# Matchings whose total costs differ by no more than rounding are ties.
TIE = 1e-12


def component_similarity(by_rep: DataFrame, reference: DataFrame, rank: int) -> DataFrame:
    """``(rep, src, dst, sim, cost)``: absolute product of column ``src`` of each
    repetition's factor with the unit-length column ``dst`` of its reference.

    Both are ``(rep, idx, vec)``; a row of the reference that the factor lacks counts as zero
    there and keeps its part of the column's length.  One join and one aggregate; per
    repetition ``rank`` squared sums leave each task.
    """
    met = unpack(reference, rank, "g").join(unpack(by_rep, rank), ["rep", "idx"], "left")
    sums = met.groupBy("rep").agg(
        *[F.expr(f"coalesce(sum(f{a} * g{b}), 0D) as d_{a}_{b}") for a in range(rank) for b in range(rank)],
        *[F.expr(f"sqrt(sum(g{b} * g{b})) as n_{b}") for b in range(rank)],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("src"),
                F.lit(b).alias("dst"),
                F.abs(ratio(F.col(f"d_{a}_{b}"), F.col(f"n_{b}"))).alias("sim"),
            )
            for a in range(rank)
            for b in range(rank)
        ]
    )
    return sums.select("rep", F.inline(cells)).withColumn("cost", F.lit(1.0) - F.col("sim"))


def _assign(cost: np.ndarray) -> list[int]:
    """Cheapest one-to-one assignment of a small square matrix: augmenting paths over
    potentials.  Entry ``s`` of the result is the column given to row ``s``; among equally
    cheap assignments it is the first in lexical order."""
    n = len(cost)
    row_gain, col_gain = np.zeros(n), np.zeros(n + 1)
    owner = np.full(n + 1, -1)  # row owning each column; the last column is the start
    for row in range(n):
        owner[n] = row
        at = n
        reach, come_from = np.full(n, np.inf), np.full(n, -1)
        used = np.zeros(n + 1, dtype=bool)
        while owner[at] >= 0:
            used[at] = True
            who = owner[at]
            slack = cost[who] - row_gain[who] - col_gain[:n]
            better = ~used[:n] & (slack < reach)
            reach[better], come_from[better] = slack[better], at
            nearest = int(np.argmin(np.where(used[:n], np.inf, reach)))
            step = reach[nearest]
            for col in np.flatnonzero(used):
                row_gain[owner[col]] += step
                col_gain[col] -= step
            reach[~used[:n]] -= step
            at = nearest
        while at != n:
            owner[at] = owner[come_from[at]]
            at = int(come_from[at])
    given = [0] * n
    for col in range(n):
        given[owner[col]] = col
    # An assignment is cheapest if and only if it uses edges without slack.
    tight = cost - row_gain[:, None] - col_gain[None, :n] <= TIE * max(1.0, float(np.abs(cost).max()))
    return _first_order(tight, given)


def _first_order(tight: np.ndarray, given: list[int]) -> list[int]:
    """The lexically least of the one-to-one assignments along allowed edges, from any of them.

    Row after row takes the least column it can have: one that a later row holds, if that row,
    and those it displaces in turn, can move on to the column set free."""
    n = len(given)
    holder = [0] * n
    for row, col in enumerate(given):
        holder[col] = row
    for row in range(n):
        for col in np.flatnonzero(tight[row, : given[row]]):
            if holder[col] < row:
                continue
            free, start = given[row], holder[col]
            # Breadth first over later rows; ``came`` says which row wants a column.
            came, queue = {int(col): row}, [start]
            while queue and free not in came:
                at = queue.pop(0)
                for other in np.flatnonzero(tight[at]):
                    if int(other) not in came and holder[other] >= row:
                        came[int(other)] = at
                        if other != free:
                            queue.append(holder[other])
            if free in came:
                at = free
                while True:
                    mover = came[at]
                    before = given[mover]
                    given[mover], holder[at] = at, mover
                    if mover == row:
                        break
                    at = before
                break
    return given


def match_components(similarity: DataFrame, rank: int) -> DataFrame:
    """``(rep, src, dst)``: for every repetition the one-to-one matching of least total
    cost; among equal ones the first in lexical order of ``dst``."""

    def solve(pdf):
        cost = np.zeros((rank, rank))
        cost[pdf["src"], pdf["dst"]] = pdf["cost"]
        given = _assign(cost)
        return pdf.iloc[:rank].assign(src=range(rank), dst=given)[["rep", "src", "dst"]]

    # rank squared rows per repetition.
    return similarity.groupBy("rep").applyInPandas(solve, "rep int, src int, dst int")


def rearrange(by_rep: DataFrame, mapping: DataFrame, rank: int) -> DataFrame:
    """Columns moved as matched: column ``dst`` of the result is column ``src``.

    ``by_rep`` has ``rep`` and ``vec``; other columns pass through.  The mapping is
    folded to one row per repetition, which is broadcast.
    """
    order = mapping.groupBy("rep").agg(
        F.array(*[F.max(F.when(F.col("dst") == d, F.col("src"))) for d in range(rank)]).alias("order")
    )
    keep = [c for c in by_rep.columns if c != "vec"]
    moved = F.transform("order", lambda s: F.element_at("vec", s + 1)).alias("vec")
    return by_rep.join(F.broadcast(order), "rep").select(*keep, moved)


def renorm(factor: DataFrame, reference: DataFrame, rank: int) -> DataFrame:
    """Every column rescaled to the length and sign of the reference column.

    ``factor`` and ``reference`` share the columns before ``vec``: ``idx`` and any
    of ``rep`` and ``mode``.  Lengths and signs are taken over the rows the
    reference has; the factor is rescaled in all its rows.
    """
    keys = [c for c in reference.columns if c != "vec"]
    groups = [c for c in keys if c != "idx"]
    met = unpack(reference, rank, "g").join(unpack(factor, rank), keys, "left")
    entry = [F.coalesce(F.col(c), F.lit(0.0)) for c in flat_cols(rank)]
    agree = [F.sum(sign_of(F.col(f"g{r}")) * sign_of(entry[r])) for r in range(rank)]
    length = [F.expr(f"sqrt(sum(g{r} * g{r}))") for r in range(rank)]
    own = [F.sqrt(F.coalesce(F.sum(entry[r] * entry[r]), F.lit(0.0))) for r in range(rank)]
    scales = [ratio(length[r], own[r]) * sign_of(agree[r]) for r in range(rank)]
    factors = met.groupBy(*groups).agg(F.array(*scales).alias("scale"))
    scaled = F.zip_with("vec", "scale", lambda v, s: v * s).alias("vec")
    keep = [c for c in factor.columns if c != "vec"]
    if not groups:
        one = factors.select("scale").scalar()
        return factor.select(*keep, F.array(*[F.col("vec")[r] * one[r] for r in range(rank)]).alias("vec"))
    # One row per repetition and mode.
    return factor.join(F.broadcast(factors), groups, "left").select(*keep, scaled)


def update_zeros(model: CPModel, rows: DataFrame) -> CPModel:
    """Fill the zero entries of existing factor rows.

    ``rows`` is ``(rep, mode, idx, vec)`` with ``idx`` in the model's numbering.  An
    entry that is zero takes the value of the first repetition that makes it
    non-zero; entries that are not zero stay.
    """
    # At most one entry per repetition and row.
    offers = rows.groupBy("mode", "idx").agg(
        F.array_sort(F.collect_list(F.struct("rep", "vec"))).alias("offers")
    )
    met = model.table().join(offers, ["mode", "idx"], "left")
    filled = F.aggregate(
        F.coalesce(F.col("offers"), F.array().cast("array<struct<rep:int,vec:array<double>>>")),
        F.col("vec"),
        lambda acc, o: F.zip_with(acc, o["vec"], lambda a, b: F.when(is_zero(a), b).otherwise(a)),
    )
    table = met.select("mode", "idx", filled.alias("vec"))
    return CPModel.from_table(table, model.lam, model.shape)
