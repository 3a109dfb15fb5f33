"""Queries on factors, sampling, CP decomposition and the incremental step."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.catalog import tables as tb
from gridloom.catalog.algebra import EVENT_WEIGHTS, SALES_WEIGHTS
from gridloom.catalog.registry import (
    EVENTS,
    SALES,
    factor_sql,
    flat_rows,
    flat_rows_sql,
    query,
    tidy,
    tidy_sql,
    uniform_sql,
)
from gridloom.model import CPModel, make_model
from gridloom.operators import aggregates, append, factors, sampling
from gridloom.operators.factors import unpack
from gridloom.plans import cp, incremental, matching, qr
from gridloom.plans.materialize import new_folder, put, stage
from gridloom.sources import construct
from gridloom.tensor import TensorFrame

MODES = (0, 1, 2)


def _model(spark, shape, rank: int, seed: int, dist: str = "uniform", lam=None) -> CPModel:
    return make_model(construct.random_factors(spark, shape, rank, seed, dist), shape, rank, lam)


def _factors_sql(rank: int, seed: int, dist: str = "uniform", lens: str = "elen", name: str = "f") -> str:
    return ", ".join(factor_sql(f"{name}{m}", lens, m, rank, seed, dist) for m in MODES)


def _table_sql(rank: int, name: str = "f", digits: int = 9) -> str:
    return " UNION ALL ".join(
        f"SELECT {m} AS mode, idx, {flat_rows_sql(rank, digits)} FROM {name}{m}" for m in MODES
    )


# --- factors made from the events ---------------------------------------------------------
#
# Component r of an index is its share of money in the kinds (for a kind: on the days) whose
# number leaves r; signed ones are centred.  ``part`` takes one of several parts of the calendar.


def _over(m: int) -> int:
    return 2 if m == 1 else 1


def _shares_sql(name: str, m: int, rank: int, phase: int = 0, part=None, signed: bool = False) -> str:
    sums = ", ".join(f"sum(cents) FILTER ((i{_over(m)} + {phase}) % {rank} = {r}) AS s{r}" for r in range(rank))
    share = "CASE WHEN a > 0 THEN CAST(coalesce(s{r}, 0) AS DOUBLE) / CAST(a AS DOUBLE) ELSE 0e0 END"
    entry = f"({share}) * {rank} - 1" if signed else share
    cols = ", ".join(f"{entry.format(r=r)} AS f{r}" for r in range(rank))
    where = f"WHERE i2 * {part[1]} // n2 = {part[0]}" if part else ""
    return f"""
{name}_s AS (SELECT i{m} AS idx, sum(cents) AS a, {sums}
  FROM (SELECT e.*, CAST(round(value * 100) AS BIGINT) AS cents FROM e, elen {where}) GROUP BY 1),
{name} AS (SELECT k AS idx, {cols} FROM elen, range(elen.n{m}) t(k) LEFT JOIN {name}_s ON {name}_s.idx = k)"""


def _shares(t: TensorFrame, m: int, rank: int, phase: int = 0, part=None, signed: bool = False) -> DataFrame:
    cells = t.frame.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    if part:
        cells = cells.where(F.expr(f"i2 * {part[1]} div {t.shape[2]} = {part[0]}"))
    of = (F.col(f"i{_over(m)}") + phase) % rank
    sums = [F.sum(F.when(of == r, F.col("cents"))).alias(f"s{r}") for r in range(rank)]
    found = cells.groupBy(F.col(f"i{m}").alias("idx")).agg(F.sum("cents").alias("a"), *sums)
    slots = t.spark.range(t.shape[m]).select(F.col("id").alias("idx")).join(found, "idx", "left")
    shares = [
        F.when(F.col("a") > 0, F.coalesce(F.col(f"s{r}"), F.lit(0)).cast("double") / F.col("a").cast("double")).otherwise(0.0)
        for r in range(rank)
    ]
    return slots.select("idx", F.array(*[s * rank - 1 if signed else s for s in shares]).alias("vec"))


def _own_factors_sql(rank: int, phase: int = 0, name: str = "f") -> str:
    return ", ".join(_shares_sql(f"{name}{m}", m, rank, phase) for m in MODES)


def _own_model(t: TensorFrame, rank: int, phase: int = 0, lam=None) -> CPModel:
    return make_model([_shares(t, m, rank, phase) for m in MODES], t.shape, rank, lam)


# --- factor tables ---------------------------------------------------------------------


@query("A6_random_uniform", f"WITH {EVENTS}, {_factors_sql(3, 6)} {_table_sql(3)}")
def _(spark, d):
    return flat_rows(_model(spark, tb.event_shape(spark, d), 3, 6).table(), 3, 9)


@query("A6_random_normal", f"WITH {EVENTS}, {_factors_sql(3, 6, 'normal')} {_table_sql(3)}")
def _(spark, d):
    return flat_rows(_model(spark, tb.event_shape(spark, d), 3, 6, "normal").table(), 3, 9)


@query(
    "D10_sign_agreement",
    f"""WITH {EVENTS}, {_shares_sql("a", 0, 3, 0, (0, 2), True)}, {_shares_sql("b", 0, 3, 0, (1, 2), True)} """
    + " UNION ALL ".join(
        f"""SELECT {r} AS r, CASE WHEN sum((CASE WHEN b.f{r} >= 0 THEN 1 ELSE -1 END)
        * (CASE WHEN a.f{r} >= 0 THEN 1 ELSE -1 END)) >= 0 THEN 1e0 ELSE -1e0 END AS sign
        FROM a JOIN b USING (idx)"""
        for r in range(3)
    ),
)
def _(spark, d):
    """Users in both halves of the calendar."""
    t = tb.events_tensor(spark, d)
    a, b = (_shares(t, 0, 3, 0, (half, 2), True) for half in range(2))
    return factors.sign_agreement(a, b, 3)


def _reps(t: TensorFrame, rank: int, phase: int, order, signed: bool = True) -> DataFrame:
    """One factor of mode 0 per repetition, ``(rep, idx, vec)``: repetition k is made from part
    ``order[k]`` of the calendar."""
    parts = [
        _shares(t, 0, rank, phase, (part, len(order)), signed).select(F.lit(rep).alias("rep"), "idx", "vec")
        for rep, part in enumerate(order)
    ]
    return reduce(DataFrame.unionByName, parts)


def _reps_sql(rank: int, phase: int, order, name: str = "x", signed: bool = True) -> str:
    each = ", ".join(
        _shares_sql(f"{name}_{rep}", 0, rank, phase, (part, len(order)), signed) for rep, part in enumerate(order)
    )
    rows = " UNION ALL ".join(f"SELECT {rep} AS rep, * FROM {name}_{rep}" for rep in range(len(order)))
    return f"{each}, {name} AS ({rows})"


@query(
    "D11_mean_factors",
    f"""WITH {EVENTS}, {_reps_sql(3, 0, (0, 1, 2))}
SELECT idx, {", ".join(f"{tidy_sql(f'sum(f{r}) / 3', 9)} AS f{r}" for r in range(3))} FROM x GROUP BY idx""",
)
def _(spark, d):
    reps = _reps(tb.events_tensor(spark, d), 3, 0, (0, 1, 2))
    return flat_rows(factors.mean_factors(reps, 3, 3), 3, 9)


# --- sampling ---------------------------------------------------------------------------


def _ranked_sql(weights: str, seed: int | str, reps: int, lens: str, p: str = "") -> str:
    u = uniform_sql(seed, "rep", "mode", "idx")
    return f"""
{p}sizes AS (SELECT 0 AS mode, greatest(n0 // 2, 1) AS k FROM {lens} UNION ALL
          SELECT 1 AS mode, greatest(n1 // 2, 1) AS k FROM {lens} UNION ALL
          SELECT 2 AS mode, greatest(n2 // 2, 1) AS k FROM {lens}),
{p}ranked AS (
  SELECT rep, mode, idx, row_number() OVER (
    PARTITION BY rep, mode ORDER BY ln({u}) / nullif(w, 0) DESC NULLS LAST, idx) AS place
  FROM {weights}, (SELECT CAST(range AS INTEGER) AS rep FROM range({reps}))),
{p}maps AS (
  SELECT rep, mode, idx AS old_idx,
         row_number() OVER (PARTITION BY rep, mode ORDER BY idx) - 1 AS new_idx
  FROM {p}ranked JOIN {p}sizes USING (mode) WHERE place <= k)"""


SAMPLE = f"{EVENTS}, {EVENT_WEIGHTS}, {_ranked_sql('weights', 5, 2, 'elen')}"


def _maps(t: TensorFrame, reps: int = 2):
    sizes = incremental.sample_sizes(t.shape, 2)
    return stage(sampling.sample_modes(aggregates.slice_weights(t), sizes, t.shape, 5, reps), "maps"), sizes


@query(
    "E1_weighted_sample",
    f"WITH {SAMPLE} SELECT old_idx AS idx FROM maps WHERE rep = 0 AND mode = 0",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    weights = aggregates.slice_weights(t).where("mode = 0").select("idx", "w")
    return sampling.weighted_sample(weights, max(1, t.shape[0] // 2), 5, 0, t.shape[0])


@query(
    "E2_relabel",
    f"WITH {SAMPLE} SELECT mode, old_idx, new_idx FROM maps WHERE rep = 0 AND mode = 0",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    weights = aggregates.slice_weights(t).where("mode = 0").select("idx", "w")
    chosen = sampling.weighted_sample(weights, max(1, t.shape[0] // 2), 5, 0, t.shape[0])
    return sampling.relabel(chosen.select(F.lit(0).alias("mode"), "idx"), ["mode"], t.shape[0])


@query("E3_sample_modes", f"WITH {SAMPLE} SELECT rep, mode, old_idx, new_idx FROM maps")
def _(spark, d):
    return _maps(tb.events_tensor(spark, d))[0]


@query(
    "C10_sample_subtensor",
    f"""WITH {SAMPLE}
SELECT a.rep AS rep, a.new_idx AS i0, b.new_idx AS i1, c.new_idx AS i2, value
FROM e JOIN maps a ON a.mode = 0 AND a.old_idx = i0
JOIN maps b ON b.mode = 1 AND b.old_idx = i1 AND b.rep = a.rep
JOIN maps c ON c.mode = 2 AND c.old_idx = i2 AND c.rep = a.rep""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    maps, sizes = _maps(t)
    return sampling.sample_subtensor(t, maps, sizes, 2)


def _sampled_factors(rank: int) -> str:
    return f"f AS ({_table_sql(rank)})"


@query(
    "E4_sample_model",
    f"""WITH {SAMPLE}, {_factors_sql(3, 6)}, {_sampled_factors(3)}
SELECT rep, maps.mode AS mode, new_idx AS idx, f0, f1, f2
FROM maps JOIN f ON f.mode = maps.mode AND f.idx = old_idx""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    return flat_rows(sampling.sample_model(_model(spark, t.shape, 3, 6), _maps(t)[0]), 3, 9)


@query(
    "E4_head_model",
    f"""WITH {EVENTS}, {_own_factors_sql(3)}, {_sampled_factors(3)}
SELECT mode, idx, f0, f1, f2 FROM f, elen
WHERE idx < CASE mode WHEN 0 THEN n0 // 2 WHEN 1 THEN n1 // 2 ELSE n2 // 2 END""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    head = sampling.head_model(_own_model(t, 3), [n // 2 for n in t.shape])
    return flat_rows(head.table(), 3, 9)


@query(
    "F2_append_rows",
    f"""WITH {EVENTS}, {_own_factors_sql(3)}, {_shares_sql("g", 2, 3, 1)},
f AS ({_table_sql(3)})
SELECT mode, idx, f0, f1, f2 FROM f UNION ALL
SELECT 2 AS mode, idx + n2 AS idx, {flat_rows_sql(3, 9)} FROM g, elen""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    grown = append.append_rows(_own_model(t, 3), 2, _shares(t, 2, 3, 1), t.shape[2])
    return flat_rows(grown.table(), 3, 9)


# --- CP decomposition ---------------------------------------------------------------------


def _mttkrp_sql(n: int, rank: int, digits: int) -> str:
    a, b = [m for m in MODES if m != n]
    sums = ", ".join(
        f"{tidy_sql(f'sum(value * f{a}.f{r} * f{b}.f{r})', digits)} AS f{r}" for r in range(rank)
    )
    return f"""SELECT {n} AS mode, e.i{n} AS idx, {sums}
FROM e JOIN f{a} ON f{a}.idx = e.i{a} JOIN f{b} ON f{b}.idx = e.i{b} GROUP BY e.i{n}"""


def _register_mttkrp(n: int) -> None:
    @query(f"G1_mttkrp_mode{n}", f"WITH {EVENTS}, {_factors_sql(3, 6)} {_mttkrp_sql(n, 3, 5)}")
    def _(spark, d):
        t = tb.events_tensor(spark, d)
        sums = cp.mttkrp(t, _model(spark, t.shape, 3, 6), n)
        return flat_rows(sums.select(F.lit(n).alias("mode"), "idx", "vec"), 3, 5)


for _n in MODES:
    _register_mttkrp(_n)


def _update_sql(n: int, a: str, b: str, out: str, cells: str = "e", lens: str = "elen") -> str:
    """CTEs of one rank-2 update of mode ``n`` from factors ``a`` and ``b``: the new
    factor ``out(idx, f0, f1)`` and its column lengths ``out_lam(l0, l1)``."""
    others = [m for m in MODES if m != n]
    return f"""
{out}_m AS (SELECT e.i{n} AS idx, sum(value * a.f0 * b.f0) AS m0, sum(value * a.f1 * b.f1) AS m1
  FROM {cells} e JOIN {a} a ON a.idx = e.i{others[0]} JOIN {b} b ON b.idx = e.i{others[1]} GROUP BY 1),
{out}_v AS (SELECT x.g00 * y.g00 AS v00, x.g01 * y.g01 AS v01, x.g11 * y.g11 AS v11
  FROM (SELECT sum(f0 * f0) AS g00, sum(f0 * f1) AS g01, sum(f1 * f1) AS g11 FROM {a}) x,
       (SELECT sum(f0 * f0) AS g00, sum(f0 * f1) AS g01, sum(f1 * f1) AS g11 FROM {b}) y),
{out}_a AS (SELECT idx, (m0 * v11 - m1 * v01) / (v00 * v11 - v01 * v01) AS a0,
                   (m1 * v00 - m0 * v01) / (v00 * v11 - v01 * v01) AS a1
  FROM {out}_m, {out}_v),
{out}_lam AS (SELECT sqrt(sum(a0 * a0)) AS l0, sqrt(sum(a1 * a1)) AS l1 FROM {out}_a),
{out} AS (SELECT k AS idx, coalesce(a0 / l0, 0) AS f0, coalesce(a1 / l1, 0) AS f1
  FROM {lens}, {out}_lam, range({lens}.n{n}) t(k) LEFT JOIN {out}_a ON {out}_a.idx = k)"""


@query(
    "G2_update_factor",
    f"""WITH {EVENTS}, {_factors_sql(2, 6)}, {_update_sql(0, "f1", "f2", "h")}
SELECT idx, {flat_rows_sql(2, 8)}, round(l0, 4) AS lam0, round(l1, 4) AS lam1 FROM h, h_lam""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    new, lam = cp.update_factor(t, _model(spark, t.shape, 2, 6), 0)
    return flat_rows(new, 2, 8).withColumns(
        {f"lam{r}": F.lit(round(v, 4)) for r, v in enumerate(lam)}
    )


SWEEP = f"""{_factors_sql(2, 6, "normal")},
{_update_sql(0, "f1", "f2", "h0")}, {_update_sql(1, "h0", "f2", "h1")}, {_update_sql(2, "h0", "h1", "h2")}"""


@query(
    "G3_als_sweep",
    f"WITH {EVENTS}, {SWEEP} "
    + " UNION ALL ".join(f"SELECT {m} AS mode, idx, {flat_rows_sql(2, 7)} FROM h{m}" for m in MODES),
)
def _(spark, d):
    model = cp.cp_als(tb.events_tensor(spark, d), rank=2, max_iter=1, seed=6)
    return flat_rows(model.table(), 2, 7)


@query(
    "G3_als_sweep_error",
    f"""WITH {EVENTS}, {SWEEP}
SELECT round(sqrt(sum(power(l0 * h0.f0 * h1.f0 * h2.f0 + l1 * h0.f1 * h1.f1 * h2.f1 - value, 2)))
  / sqrt(sum(value * value)), 8) AS error
FROM e JOIN h0 ON h0.idx = i0 JOIN h1 ON h1.idx = i1 JOIN h2 ON h2.idx = i2, h2_lam""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    trace: list[float] = []
    cp.cp_als(t, rank=2, max_iter=1, seed=6, trace=trace)
    return spark.range(1).select(tidy(F.lit(trace[-1]), 8).alias("error"))


def _fit_sql(count: int, start: Sequence[str], out: str, cells: str = "e", lens: str = "elen") -> str:
    """CTEs ``out0``.. of several sweeps over some cells; sweep k gives numbers 3k, 3k + 1 and 3k + 2."""
    names, parts = list(start), []
    for k in range(count):
        for m in MODES:
            a, b = [names[o] for o in MODES if o != m]
            names[m] = f"{out}{3 * k + m}"
            parts.append(_update_sql(m, a, b, names[m], cells, lens).replace(" AS (", " AS MATERIALIZED ("))
    return ", ".join(parts)


def _sweeps_sql(count: int) -> str:
    """Sweeps over all events as ``h0``.., from random factors."""
    return f"{_factors_sql(2, 6, 'normal')}, {_fit_sql(count, ('f0', 'f1', 'f2'), 'h')}"


SWEEPS = 3


@query(
    "G3_als_three_sweeps",
    f"WITH {EVENTS}, {_sweeps_sql(SWEEPS)} "
    + " UNION ALL ".join(f"SELECT {m} AS mode, idx, {flat_rows_sql(2, 6)} FROM h{3 * SWEEPS - 3 + m}" for m in MODES),
)
def _(spark, d):
    model = cp.cp_als(tb.events_tensor(spark, d), rank=2, max_iter=SWEEPS, tol=0.0, seed=6)
    return flat_rows(model.table(), 2, 6)


@query(
    "G3_als_errors",
    f"WITH {EVENTS}, {_sweeps_sql(SWEEPS)} "
    + " UNION ALL ".join(
        f"""SELECT {k} AS sweep, round(sqrt(sum(power(l0 * a.f0 * b.f0 * c.f0 + l1 * a.f1 * b.f1 * c.f1 - value, 2)))
  / sqrt(sum(value * value)), 8) AS error
FROM e JOIN h{3 * k} a ON a.idx = i0 JOIN h{3 * k + 1} b ON b.idx = i1 JOIN h{3 * k + 2} c ON c.idx = i2, h{3 * k + 2}_lam"""
        for k in range(SWEEPS)
    ),
)
def _(spark, d):
    """The error after every sweep."""
    trace: list[float] = []
    cp.cp_als(tb.events_tensor(spark, d), rank=2, max_iter=SWEEPS, tol=0.0, seed=6, trace=trace)
    rows = F.array(*[F.struct(F.lit(k).alias("sweep"), tidy(F.lit(v), 8).alias("error")) for k, v in enumerate(trace)])
    return spark.range(1).select(F.inline(rows))


#: Sweeps the fit to its end may take, and the change of the error that ends it.
MOST_SWEEPS, STOP = 12, 1e-3


def _whole_fit_sql() -> str:
    """Every sweep a fit might take; the first one that changes the error by no more than ``STOP`` counts."""
    sweeps = [tuple(f"h{3 * k + m}" for m in MODES) for k in range(MOST_SWEEPS)]
    errors = " UNION ALL ".join(
        f"""SELECT {k} AS sweep, sqrt(sum(power(l0 * a.f0 * b.f0 * c.f0 + l1 * a.f1 * b.f1 * c.f1 - value, 2)))
  / sqrt(sum(value * value)) AS error FROM s JOIN {a} a ON a.idx = i0 JOIN {b} b ON b.idx = i1 JOIN {c} c ON c.idx = i2, {c}_lam"""
        for k, (a, b, c) in enumerate(sweeps)
    )
    rows = " UNION ALL ".join(
        f"""SELECT {m} AS mode, idx, {flat_rows_sql(2, 5)}, ended + 1 AS sweeps, round(error, 7) AS error
  FROM {h}, ending WHERE ended = {k}"""
        for k, names in enumerate(sweeps)
        for m, h in enumerate(names)
    )
    return f"""WITH {SALES}, {_factors_sql(2, 6, "normal", "slen")},
{_fit_sql(MOST_SWEEPS, ("f0", "f1", "f2"), "h", "s", "slen")}, errors AS MATERIALIZED ({errors}),
changes AS (SELECT sweep, error, abs(error - lag(error, 1, 0) OVER (ORDER BY sweep)) AS change FROM errors),
ending AS MATERIALIZED (SELECT sweep AS ended, error FROM changes WHERE change <= {STOP} OR sweep = {MOST_SWEEPS - 1}
  ORDER BY sweep LIMIT 1) {rows}"""


@query("G3_als_to_its_end", _whole_fit_sql())
def _(spark, d):
    """Sales at rank 2 until the error hardly changes: the factor rows, the sweeps taken and the error."""
    trace: list[float] = []
    model = cp.cp_als(tb.sales_tensor(spark, d), rank=2, max_iter=MOST_SWEEPS, tol=STOP, trace=trace)
    return flat_rows(model.table(), 2, 5).withColumns(
        {"sweeps": F.lit(len(trace)), "error": tidy(F.lit(trace[-1]), 7)}
    )


@query("G3_cp_als")
def _(spark, d):
    """Sales at rank 5, eight sweeps at most: the factor table."""
    model = cp.cp_als(tb.sales_tensor(spark, d), rank=5, max_iter=8, tol=1e-3)
    return flat_rows(model.table(), 5, 6)


LAM = (5.0, 0.5, 2.0)
VALUE = " + ".join(f"{w}e0 * f0.f{r} * f1.f{r} * f2.f{r}" for r, w in enumerate(LAM))


@query(
    "G4_predict",
    f"""WITH {EVENTS}, {_factors_sql(3, 6)}
SELECT i0, i1, i2, round({VALUE}, 9) AS predicted
FROM e JOIN f0 ON f0.idx = i0 JOIN f1 ON f1.idx = i1 JOIN f2 ON f2.idx = i2""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    rows = cp.predict(t.frame.drop("value"), _model(spark, t.shape, 3, 6, lam=LAM))
    return rows.withColumn("predicted", tidy("predicted", 9))


@query(
    "G5_reconstruct",
    f"""WITH {EVENTS}, {_own_factors_sql(3)}
SELECT f0.idx AS i0, f1.idx AS i1, f2.idx AS i2, round({VALUE}, 9) AS value FROM f0, f1, f2""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    tables = [stage(f, "factor") for f in _own_model(t, 3).factors]
    full = cp.reconstruct(make_model(tables, t.shape, 3, LAM))
    return full.frame.withColumn("value", tidy("value", 9))


# Fixed value: kinds of events in the table.
KINDS = 5


def _kind_sums() -> str:
    return ", ".join(
        f"round(coalesce(sum(value) FILTER (i1 = {k}), 0), 6) AS f{k}" for k in range(KINDS)
    )


def _kind_zeros() -> str:
    return ", ".join(f"coalesce(f{k}, 0) AS f{k}" for k in range(KINDS))


@query(
    "G6_make_model",
    f"""WITH {EVENTS},
u AS (SELECT i0 AS idx, {_kind_sums()} FROM e GROUP BY 1),
w AS (SELECT i2 AS idx, {_kind_sums()} FROM e GROUP BY 1)
SELECT 0 AS mode, t.k AS idx, {_kind_zeros()} FROM elen, range(n0) t(k) LEFT JOIN u ON u.idx = t.k
UNION ALL
SELECT 1 AS mode, t.k AS idx, {_kind_zeros()} FROM elen, range(n2) t(k) LEFT JOIN w ON w.idx = t.k""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    shape = (t.shape[0], t.shape[2])
    tables = [factors.rows_from_columns(t.frame, KINDS, i, "i1") for i in ("i0", "i2")]
    full = [factors.complete(f, n, KINDS) for f, n in zip(tables, shape, strict=True)]
    return flat_rows(make_model(full, shape, KINDS).table(), KINDS)


@query(
    "G7_pseudo_inverse",
    f"""WITH {EVENTS}, x AS (SELECT i0 AS idx, coalesce(sum(value) FILTER (i1 % 2 = 0), 0) AS x0,
  coalesce(sum(value) FILTER (i1 % 2 = 1), 0) AS x1 FROM e GROUP BY 1),
g AS (SELECT sum(x0 * x0) AS g00, sum(x0 * x1) AS g01, sum(x1 * x1) AS g11 FROM x)
SELECT idx, {tidy_sql("(x0 * g11 - x1 * g01) / (g00 * g11 - g01 * g01)", 10)} AS f0,
       {tidy_sql("(x1 * g00 - x0 * g01) / (g00 * g11 - g01 * g01)", 10)} AS f1 FROM x, g""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d, shaped=False)
    halves = t.frame.withColumn("half", F.col("i1") % 2)
    return flat_rows(qr.pseudo_inverse(factors.rows_from_columns(halves, 2, "i0", "half"), 2), 2, 10)


@query(
    "G7_pseudo_inverse_near",
    f"""WITH {EVENTS}, x AS (SELECT i0 AS idx, sum(value) AS s, sum(value * (i2 + 1)) AS u FROM e GROUP BY 1),
g AS (SELECT sum(s * s) AS ss, sum(s * u) AS su, sum(u * u) AS uu FROM x),
h AS (SELECT idx, (s * uu - u * su) / (ss * uu - su * su) AS a, (u * ss - s * su) / (ss * uu - su * su) AS c FROM x, g)
SELECT idx, {tidy_sql("a - c * 1e6", 4)} AS f0, {tidy_sql("c * 1e6", 4)} AS f1 FROM h""",
)
def _(spark, d):
    """Pseudo-inverse of columns s and s + u / 10^6, a matrix of condition above 10^6; the exact one
    follows from that of (s, u)."""
    sums = tb.events_tensor(spark, d, shaped=False).frame.groupBy(F.col("i0").alias("idx")).agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * (F.col("i2") + 1)).alias("u")
    )
    rows = sums.select("idx", F.array(F.col("s"), F.col("s") + F.col("u") * 1e-6).alias("vec"))
    inverse = unpack(qr.pseudo_inverse(rows, 2), 2, "f")
    return inverse.select("idx", *[tidy(f"f{r}", 4).alias(f"f{r}") for r in range(2)])


@query(
    "D8_relative_error",
    f"""WITH {EVENTS}, {_factors_sql(3, 6)}
SELECT round(sqrt(sum(power({VALUE} - value, 2))) / sqrt(sum(value * value)), 9) AS error
FROM e JOIN f0 ON f0.idx = i0 JOIN f1 ON f1.idx = i1 JOIN f2 ON f2.idx = i2""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    error = cp.relative_error(t, _model(spark, t.shape, 3, 6, lam=LAM))
    return error.select(tidy("error", 9).alias("error"))


# --- lining components up ---------------------------------------------------------------

RANK = 4
# Halves of the calendar against each other, components of one numbered differently.
FITS = _reps_sql(RANK, 0, (0, 1))
REFS = _reps_sql(RANK, 1, (1, 0), name="y")
PAIRS = " UNION ALL ".join(
    f"""SELECT rep, {a} AS src, {b} AS dst, abs(sum(x.f{a} * y.f{b})) / sqrt(sum(y.f{b} * y.f{b})) AS sim
FROM x JOIN y USING (rep, idx) GROUP BY rep"""
    for a in range(RANK)
    for b in range(RANK)
)
SIM = f"{EVENTS}, {FITS}, {REFS}, sim AS ({PAIRS})"
TOTAL = " + ".join(f"s{a}.cost" for a in range(RANK))
MATCH = f"""{SIM}, c AS (SELECT rep, src, dst, 1 - sim AS cost FROM sim),
orders AS (
  SELECT s0.rep AS rep, {", ".join(f"s{a}.dst AS d{a}" for a in range(RANK))}, {TOTAL} AS total
  FROM c s0 {" ".join(
      f"JOIN c s{a} ON s{a}.rep = s0.rep AND s{a}.src = {a} AND s{a}.dst NOT IN ({', '.join(f's{b}.dst' for b in range(a))})"
      for a in range(1, RANK))}
  WHERE s0.src = 0),
best AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY rep ORDER BY total) = 1),
match AS ({" UNION ALL ".join(f"SELECT rep, {a} AS src, d{a} AS dst FROM best" for a in range(RANK))})"""


def _pair(spark, d):
    t = tb.events_tensor(spark, d)
    return _reps(t, RANK, 0, (0, 1)), _reps(t, RANK, 1, (1, 0))


@query(
    "H1_component_similarity",
    f"WITH {SIM} SELECT rep, src, dst, round(sim, 8) AS sim, round(1 - sim, 8) AS cost FROM sim",
)
def _(spark, d):
    sim = matching.component_similarity(*_pair(spark, d), RANK)
    return sim.select("rep", "src", "dst", tidy("sim", 8).alias("sim"), tidy("cost", 8).alias("cost"))


@query("H2_match_components", f"WITH {MATCH} SELECT rep, src, dst FROM match")
def _(spark, d):
    return matching.match_components(matching.component_similarity(*_pair(spark, d), RANK), RANK)


# More components than kinds: those without a kind are all zero, so their order is a tie.
WIDE = 8
WIDE_PAIRS = " UNION ALL ".join(
    f"""SELECT rep, {a} AS src, {b} AS dst, 1 - CASE WHEN sum(y.f{b} * y.f{b}) = 0 THEN 0e0
  ELSE abs(sum(x.f{a} * y.f{b})) / sqrt(sum(y.f{b} * y.f{b})) END AS cost FROM x JOIN y USING (rep, idx) GROUP BY rep"""
    for a in range(WIDE)
    for b in range(WIDE)
)
WIDE_ORDER = ", ".join(f"s{a}.dst" for a in range(WIDE))


@query(
    "H2_match_ties",
    f"""WITH {EVENTS}, {_reps_sql(WIDE, 0, (0, 1), signed=False)}, {_reps_sql(WIDE, 1, (1, 0), "y", signed=False)},
c AS MATERIALIZED ({WIDE_PAIRS}),
best AS (
  SELECT s0.rep AS rep, {", ".join(f"s{a}.dst AS d{a}" for a in range(WIDE))}
  FROM c s0 {" ".join(
      f"JOIN c s{a} ON s{a}.rep = s0.rep AND s{a}.src = {a} AND s{a}.dst NOT IN ({', '.join(f's{b}.dst' for b in range(a))})"
      for a in range(1, WIDE))}
  WHERE s0.src = 0
  QUALIFY row_number() OVER (
    PARTITION BY s0.rep ORDER BY round({" + ".join(f"s{a}.cost" for a in range(WIDE))}, 9), {WIDE_ORDER}) = 1)
{" UNION ALL ".join(f"SELECT rep, {a} AS src, d{a} AS dst FROM best" for a in range(WIDE))}""",
)
def _(spark, d):
    """Rank 8, where several orders of the components cost the same: the first of them."""
    t = tb.events_tensor(spark, d)
    fits, refs = _reps(t, WIDE, 0, (0, 1), signed=False), _reps(t, WIDE, 1, (1, 0), signed=False)
    return matching.match_components(matching.component_similarity(fits, refs, WIDE), WIDE)


@query(
    "H3_rearrange",
    f"""WITH {MATCH}, long AS (SELECT rep, idx, dst, CASE src {" ".join(f"WHEN {r} THEN f{r}" for r in range(RANK))} END AS v
FROM x JOIN match USING (rep))
SELECT rep, idx, {", ".join(f"{tidy_sql(f'max(v) FILTER (dst = {r})', 9)} AS f{r}" for r in range(RANK))} FROM long GROUP BY 1, 2""",
)
def _(spark, d):
    fits, refs = _pair(spark, d)
    match = matching.match_components(matching.component_similarity(fits, refs, RANK), RANK)
    return flat_rows(matching.rearrange(fits, match, RANK), RANK, 9)


def _agree(r: int) -> str:
    return (
        f"(CASE WHEN sum((CASE WHEN y.f{r} >= 0 THEN 1 ELSE -1 END) * "
        f"(CASE WHEN x.f{r} >= 0 THEN 1 ELSE -1 END)) >= 0 THEN 1 ELSE -1 END)"
    )


@query(
    "H4_renorm",
    f"""WITH {EVENTS}, {FITS}, {REFS}, sampled AS (SELECT y.* FROM y, elen WHERE idx < n0 // 2),
scale AS (SELECT rep, {", ".join(
        f"sqrt(sum(y.f{r} * y.f{r})) / sqrt(sum(x.f{r} * x.f{r})) * {_agree(r)} AS s{r}" for r in range(RANK))}
  FROM sampled y JOIN x USING (rep, idx) GROUP BY rep)
SELECT rep, idx, {", ".join(f"{tidy_sql(f'f{r} * s{r}', 9)} AS f{r}" for r in range(RANK))} FROM x JOIN scale USING (rep)""",
)
def _(spark, d):
    fits, refs = _pair(spark, d)
    half = tb.event_shape(spark, d)[0] // 2
    return flat_rows(matching.renorm(fits, refs.where(F.col("idx") < half), RANK), RANK, 9)


def _holes(vec, below: float):
    return F.transform(vec, lambda v: F.when(v < below, F.lit(0.0)).otherwise(v))


def _filled(r: int) -> str:
    zero = "abs({}) <= 1e-7"
    return (
        f"CASE WHEN NOT {zero.format(f'm.f{r}')} THEN m.f{r} "
        f"WHEN o0.f{r} IS NOT NULL AND NOT {zero.format(f'o0.f{r}')} THEN o0.f{r} "
        f"WHEN o1.f{r} IS NOT NULL THEN o1.f{r} "
        f"WHEN o0.f{r} IS NOT NULL THEN o0.f{r} ELSE m.f{r} END"
    )


def _hole_rows(source: str, below: str) -> str:
    return ", ".join(f"CASE WHEN {source}.f{r} < {below} THEN 0 ELSE {source}.f{r} END AS f{r}" for r in range(3))


@query(
    "H5_update_zeros",
    f"""WITH {SAMPLE}, {_factors_sql(3, 6)}, {_factors_sql(3, 7, name="g")},
f AS ({" UNION ALL ".join(f"SELECT {m} AS mode, * FROM f{m}" for m in MODES)}),
g AS ({" UNION ALL ".join(f"SELECT {m} AS mode, * FROM g{m}" for m in MODES)}),
m AS (SELECT mode, idx, {_hole_rows("f", "0.4e0")} FROM f),
o AS (SELECT rep, maps.mode AS mode, old_idx AS idx, {_hole_rows("g", "0.5e0 - rep * 0.3e0")}
      FROM maps JOIN g ON g.mode = maps.mode AND g.idx = new_idx)
SELECT m.mode AS mode, m.idx AS idx, {", ".join(f"round({_filled(r)}, 9) AS f{r}" for r in range(3))}
FROM m LEFT JOIN (SELECT * FROM o WHERE rep = 0) o0 USING (mode, idx)
LEFT JOIN (SELECT * FROM o WHERE rep = 1) o1 USING (mode, idx)""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    base = _model(spark, t.shape, 3, 6)
    model = CPModel([f.select("idx", _holes("vec", 0.4).alias("vec")) for f in base.factors], base.lam, t.shape)
    offers = (
        _maps(t)[0]
        .join(_model(spark, t.shape, 3, 7).table().withColumnRenamed("idx", "new_idx"), ["mode", "new_idx"])
        .select("rep", "mode", F.col("old_idx").alias("idx"), "vec")
    )
    below = F.lit(0.5) - F.col("rep") * F.lit(0.3)
    holed = F.transform("vec", lambda v: F.when(v < below, F.lit(0.0)).otherwise(v))
    filled = matching.update_zeros(model, offers.withColumn("vec", holed))
    return flat_rows(filled.table(), 3, 9)


# --- the incremental step -----------------------------------------------------------------


def _split(spark, d, sales: bool = False):
    """The first two thirds of the growing mode, and the rest as new slices."""
    t = tb.sales_tensor(spark, d) if sales else tb.events_tensor(spark, d)
    cut = t.shape[2] * 2 // 3
    return construct.slice_window(t, 2, 0, cut), construct.slice_window(t, 2, cut, t.shape[2])


@query(
    "H7_append_slice",
    f"""WITH {SALES}, {SALES_WEIGHTS}
SELECT mode, idx, w, (SELECT count(*) FROM s) AS cells FROM weights""",
)
def _(spark, d):
    old, new = _split(spark, d, sales=True)
    state = incremental.DecompositionState(old, aggregates.slice_weights(old))
    grown = incremental.append_slice(state, new, 2)
    return grown.weights.withColumn("cells", aggregates.nnz(grown.tensor).scalar())


def _base_sql(cells: str, lens: str, cut: str, sweeps: int) -> str:
    """CTEs of the rank-2 model of the slices before ``cut``, fitted in some sweeps, as ``b0``.. to
    ``b{3 * sweeps - 1}``; the last three are its factors."""
    start = _factors_sql(2, 6, "normal", "blen", "bf")
    fit = _fit_sql(sweeps, ("bf0", "bf1", "bf2"), "b", "bcells", "blen")
    return f"""
blen AS MATERIALIZED (SELECT n0, n1, {cut} AS n2 FROM {lens}),
bcells AS MATERIALIZED (SELECT c.* FROM {cells} c, blen WHERE i2 < n2), {start}, {fit}"""


def _step_sql(
    p: str, cells: str, lens: str, cut: str, end: str, base: Sequence[str], reps: int, sweeps: int,
    sequential: bool = False,
) -> tuple[str, list[str]]:
    """CTEs of one step of a rank-2 model from the slices before ``cut`` to those before ``end``, and
    the names of the new factors ``(idx, f0, f1)``; all names begin with ``p``."""
    weights = " UNION ALL ".join(
        f"""SELECT {m} AS mode, k AS idx, coalesce(w, 0) AS w FROM {p}len, range({p}len.n{m}) t(k)
  LEFT JOIN (SELECT i{m} AS idx, sum(value * value) AS w FROM {p}old GROUP BY 1) ON idx = k"""
        for m in MODES
    )
    parts = [f"""
{p}len AS (SELECT n0, n1, {cut} AS n2, {end} - {cut} AS batch FROM {lens}),
{p}old AS (SELECT c.* FROM {cells} c, {p}len WHERE i2 < n2),
{p}new AS (SELECT i0, i1, i2 - n2 AS i2, value FROM {cells}, {p}len WHERE i2 >= n2 AND i2 < n2 + batch),
{p}weights AS ({weights}),
{_ranked_sql(f"{p}weights", f"(SELECT n2 FROM {p}len)", reps, f"{p}len", p)},
{p}fit AS (SELECT greatest(n0 // 2, 1) AS n0, greatest(n1 // 2, 1) AS n1, greatest(n2 // 2, 1) AS have,
  greatest(n2 // 2, 1) + batch AS n2 FROM {p}len),
{_factors_sql(2, 6, "normal", f"{p}fit", f"{p}f")}"""]
    model = list(base)
    for rep in range(reps):
        q = f"{p}{rep}"
        at = [f"JOIN {p}maps m{m} ON m{m}.rep = {rep} AND m{m}.mode = {m} AND m{m}.old_idx = i{m}" for m in MODES]
        parts.append(f"""
{q}cells AS (SELECT m0.new_idx AS i0, m1.new_idx AS i1, m2.new_idx AS i2, value FROM {p}old {" ".join(at)}
  UNION ALL SELECT m0.new_idx, m1.new_idx, i2 + have, value FROM {p}new {at[0]} {at[1]}, {p}fit)""")
        parts.append(_fit_sql(sweeps, [f"{p}f{m}" for m in MODES], f"{q}h", f"{q}cells", f"{p}fit"))
        fit = [f"{q}h{3 * (sweeps - 1) + m}" for m in MODES]
        refs = model if sequential else base
        sims = ", ".join(
            f"abs(sum(x.f{a} * y.f{b})) / sqrt(sum(y.f{b} * y.f{b})) AS s{a}{b}" for a in range(2) for b in range(2)
        )
        for m in MODES:
            parts.append(f"""
{q}ref{m} AS (SELECT new_idx AS idx, f0, f1 FROM {p}maps JOIN {refs[m]} ON idx = old_idx WHERE rep = {rep} AND mode = {m})""")
        parts.append(f"""
{q}turn AS (SELECT s01 + s10 > s00 + s11 AS turned FROM (SELECT {sims} FROM {fit[0]} x JOIN {q}ref0 y USING (idx)))""")
        for m in MODES:
            scales = ", ".join(
                f"sqrt(sum(y.f{r} * y.f{r})) / sqrt(sum(x.f{r} * x.f{r})) * {_agree(r)} AS s{r}" for r in range(2)
            )
            parts.append(f"""
{q}moved{m} AS (SELECT idx, if(turned, f1, f0) AS f0, if(turned, f0, f1) AS f1 FROM {fit[m]}, {q}turn),
{q}scale{m} AS (SELECT {scales} FROM {q}moved{m} x JOIN {q}ref{m} y USING (idx)),
{q}rows{m} AS (SELECT idx, f0 * s0 AS f0, f1 * s1 AS f1 FROM {q}moved{m}, {q}scale{m})""")
        for m in MODES:
            filled = ", ".join(
                f"CASE WHEN o.f{r} IS NOT NULL AND abs(b.f{r}) <= 1e-7 THEN o.f{r} ELSE b.f{r} END AS f{r}" for r in range(2)
            )
            parts.append(f"""
{q}model{m} AS (SELECT b.idx AS idx, {filled} FROM {model[m]} b LEFT JOIN (
  SELECT old_idx AS idx, f0, f1 FROM {p}maps JOIN {q}rows{m} ON idx = new_idx WHERE rep = {rep} AND mode = {m}) o USING (idx))""")
        model = [f"{q}model{m}" for m in MODES]
    fresh = " UNION ALL ".join(f"SELECT idx - have AS idx, f0, f1 FROM {p}{rep}rows2, {p}fit WHERE idx >= have" for rep in range(reps))
    parts.append(f"""
{p}grown AS (SELECT * FROM {model[2]} UNION ALL
  SELECT idx + n2 AS idx, sum(f0) / {reps} AS f0, sum(f1) / {reps} AS f1 FROM ({fresh}), {p}len GROUP BY ALL)""")
    return ", ".join(parts).replace(" AS (", " AS MATERIALIZED ("), [*model[:2], f"{p}grown"]


def _model_sql(names: Sequence[str], digits: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT {m} AS mode, idx, {flat_rows_sql(2, digits)} FROM {t}" for m, t in enumerate(names))


CUT = "(n2 * 2 // 3)"


def _stepped_sql(sequential: bool) -> str:
    base = [f"b{3 * SWEEPS - 3 + m}" for m in MODES]
    step, names = _step_sql("p", "e", "elen", CUT, "n2", base, 2, SWEEPS, sequential)
    return f"WITH {EVENTS}, {_base_sql('e', 'elen', CUT, SWEEPS)}, {step} {_model_sql(names)}"


def _stepped(spark, d, sequential: bool):
    old, new = _split(spark, d)
    state = incremental.start_state(old, cp.cp_als(old, rank=2, max_iter=SWEEPS, tol=0.0))
    return incremental.incremental_step(
        state, new, 2, factor=2, reps=2, max_iter=SWEEPS, tol=0.0, sequential=sequential
    )


@query("H6_incremental_step", _stepped_sql(False))
def _(spark, d):
    """The model after one step of two repetitions side by side: factor rows of all modes."""
    return flat_rows(_stepped(spark, d, False).model.table(), 2)


@query("H6_sequential_step", _stepped_sql(True))
def _(spark, d):
    """The same, the second repetition going on from the model the first one made."""
    return flat_rows(_stepped(spark, d, True).model.table(), 2)


def _streamed(spark, d):
    """Sales in two streamed slices after a first third: the state, and the batches it was made in."""
    from gridloom.streaming.slices import init_state, load_state, stream_decompose

    t = tb.sales_tensor(spark, d)
    folder = new_folder(spark, "stream")
    t = TensorFrame(put(t.frame, f"{folder}/all"), t.shape, True, True)
    first, last = t.shape[2] // 3, t.shape[2] * 2 // 3
    old = construct.slice_window(t, 2, 0, first)
    init_state(f"{folder}/state", old, cp.cp_als(old, rank=2, max_iter=1))
    for low, high in ((first, last), (last, t.shape[2])):
        rows = t.frame.where((F.col("i2") >= low) & (F.col("i2") < high))
        rows.write.mode("append").parquet(f"{folder}/slices")
        # All files that have come are one batch; the next start of the stream goes on from there.
        stream = spark.readStream.schema(t.frame.schema).parquet(f"{folder}/slices")
        stream_decompose(
            stream, f"{folder}/state", f"{folder}/progress", 2, factor=2, reps=1, max_iter=1
        ).awaitTermination()
    commits = spark.read.parquet(f"{folder}/state/commits").agg((F.count(F.lit(1)) - 1).alias("batches"))
    return load_state(spark, f"{folder}/state"), commits


@query(
    "H8_stream_decompose",
    f"""WITH {SALES}, {SALES_WEIGHTS}
SELECT mode, idx, w, (SELECT count(*) FROM s) AS cells, 2::BIGINT AS batches FROM weights""",
)
def _(spark, d):
    """The weights and cells kept by the stream's state."""
    state, commits = _streamed(spark, d)
    return state.weights.select(
        "mode", "idx", "w",
        aggregates.nnz(state.tensor).scalar().alias("cells"),
        commits.scalar().alias("batches"),
    )


def _streamed_sql() -> str:
    thirds = ["(n2 // 3)", "(n2 * 2 // 3)", "n2"]
    first, names = _step_sql("p", "s", "slen", thirds[0], thirds[1], ("b0", "b1", "b2"), 1, 1)
    second, names = _step_sql("q", "s", "slen", thirds[1], thirds[2], names, 1, 1)
    return f"WITH {SALES}, {_base_sql('s', 'slen', thirds[0], 1)}, {first}, {second} {_model_sql(names)}"


@query("H8_stream_model", _streamed_sql())
def _(spark, d):
    """The model the stream's state holds after two steps of a sweep each: factor rows of all modes."""
    return flat_rows(_streamed(spark, d)[0].model.table(), 2)
