"""Queries on construction, projections, products and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import tables as tb
from gridloom.catalog.registry import EVENTS, SALES, VECTORS, query, tidy, tidy_sql
from gridloom.functions import is_close, is_zero
from gridloom.operators import aggregates, append, factors, modes, products
from gridloom.sources import construct
from gridloom.tensor import TensorFrame

CELLS3 = "i0, i1, i2, value"


def _rounded(tensor: TensorFrame, digits: int = 6):
    return tensor.frame.withColumn("value", tidy("value", digits))


# --- construction ------------------------------------------------------------------


@query("A1_from_coo", f"WITH {SALES} SELECT {CELLS3} FROM s")
def _(spark, d):
    return tb.sales_tensor(spark, d, shaped=False).frame


@query("A1_from_coo_events", f"WITH {EVENTS} SELECT {CELLS3} FROM e")
def _(spark, d):
    return tb.events_tensor(spark, d, shaped=False).frame


@query("A2_from_arrays", f"WITH {VECTORS} SELECT i0, i1, value FROM v")
def _(spark, d):
    return tb.vectors_matrix(spark, d).frame


@query(
    "A4_densify",
    f"""WITH {EVENTS}
SELECT x AS i0, y AS i1, z AS i2, coalesce(value, 0e0) AS value
FROM elen, range(elen.n0) a(x), range(elen.n1) b(y), range(elen.n2) c(z)
LEFT JOIN e ON i0 = x AND i1 = y AND i2 = z""",
)
def _(spark, d):
    return construct.densify(tb.events_tensor(spark, d)).frame


@query(
    "A5_slice_batches",
    f"WITH {EVENTS} SELECT i2 // 7 AS batch, i0, i1, i2 % 7 AS i2, value FROM e",
)
def _(spark, d):
    return construct.slice_batches(tb.events_tensor(spark, d, shaped=False), 2, 7)


@query(
    "A7_rows_from_columns",
    f"""WITH {EVENTS}
SELECT i0 AS idx, {", ".join(f"round(coalesce(sum(value) FILTER (i1 = {r}), 0), 6) AS f{r}" for r in range(5))}
FROM e GROUP BY i0""",
)
def _(spark, d):
    rows = factors.rows_from_columns(tb.events_tensor(spark, d, shaped=False).frame, 5, "i0", "i1")
    return rows.select("idx", *[tidy(F.col("vec")[r]).alias(f"f{r}") for r in range(5)])


@query(
    "A8_from_columns",
    f"""WITH {EVENTS}
SELECT i0, 0::BIGINT AS i1, value FROM (SELECT i0, round(sum(value), 6) AS value FROM e GROUP BY 1)
UNION ALL
SELECT i0, 1::BIGINT AS i1, value FROM (SELECT i0, sum(value) AS value FROM ecount GROUP BY 1)""",
)
def _(spark, d):
    total = construct.from_vector(tb.events_tensor(spark, d, shaped=False).frame, "i0", "value")
    count = construct.from_vector(tb.event_counts(spark, d).frame, "i0", "value")
    return _rounded(factors.from_columns([total, count]))


# --- projections, maps, predicates ----------------------------------------------------


@query("B1_keep_modes", f"WITH {EVENTS} SELECT i0, i2 AS i1, value FROM e")
def _(spark, d):
    return modes.keep_modes(tb.events_tensor(spark, d, shaped=False), 2, 0).frame


@query("B2_drop_modes", f"WITH {EVENTS} SELECT i1 AS i0, value FROM e")
def _(spark, d):
    return modes.drop_modes(tb.events_tensor(spark, d, shaped=False), 0, 2).frame


@query(
    "B3_append_modes",
    f"WITH {EVENTS} SELECT i0, i1, i2, 7::BIGINT AS i3, 9::BIGINT AS i4, value FROM e",
)
def _(spark, d):
    return modes.append_modes(tb.events_tensor(spark, d, shaped=False), 7, 9).frame


@query("B4_with_mode", f"WITH {EVENTS} SELECT i0, i1, i2 + 10 AS i2, value FROM e")
def _(spark, d):
    return modes.with_mode(tb.events_tensor(spark, d, shaped=False), 2, lambda i: i + 10).frame


@query("B4_set_mode", f"WITH {EVENTS} SELECT i0, 200::BIGINT AS i1, i2, value FROM e")
def _(spark, d):
    return modes.with_mode(tb.events_tensor(spark, d, shaped=False), 1, 200).frame


@query("B6_map_modes", f"WITH {EVENTS} SELECT i0, i1 * 2 + 1 AS i1, i2 * 3 + 2 AS i2, value FROM e")
def _(spark, d):
    return modes.map_modes(tb.events_tensor(spark, d, shaped=False), lambda i, m: i * (m + 1) + m).frame


@query("B7_map_entries", f"WITH {SALES} SELECT i2 AS i0, i0 AS i1, value * 2 + i1 AS value FROM s")
def _(spark, d):
    return modes.map_entries(
        tb.sales_tensor(spark, d, shaped=False),
        lambda coord, value: value * 2 + coord[1],
        lambda coord, value: [coord[2], coord[0]],
    ).frame


@query("B8_transpose", f"WITH {VECTORS} SELECT i1 AS i0, i0 AS i1, value FROM v")
def _(spark, d):
    return modes.transpose(tb.vectors_matrix(spark, d)).frame


@query(
    "B9_forall",
    f"""WITH {EVENTS}
SELECT 'positive' AS test, bool_and(value > 0) AS holds FROM e
UNION ALL SELECT 'below ten', bool_and(value < 10) FROM e
UNION ALL SELECT 'none stored', coalesce(bool_and(value > 0), true) FROM e WHERE value < 0""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d, shaped=False)
    negative = TensorFrame(t.frame.where("value < 0"))
    tests = [
        ("positive", t, lambda v: v > 0),
        ("below ten", t, lambda v: v < 10),
        ("none stored", negative, lambda v: v > 0),
    ]
    rows = [modes.forall(x, cond).select(F.lit(name).alias("test"), "holds") for name, x, cond in tests]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "B10_close_to_zero",
    f"""WITH {VECTORS}
SELECT i0, i1, abs(value * 1e-6) <= 1e-7 AS zero, abs(value - 0.05e0) <= 0.01e0 AS near FROM v""",
)
def _(spark, d):
    v = F.col("value")
    return tb.vectors_matrix(spark, d).frame.select(
        "i0", "i1", is_zero(v * 1e-6).alias("zero"), is_close(v, 0.05, 0.01).alias("near")
    )


@query("B11_column", f"WITH {VECTORS} SELECT i0, value FROM v WHERE i1 = 5")
def _(spark, d):
    return modes.column(tb.vectors_matrix(spark, d), 5).frame


# --- products ----------------------------------------------------------------------------


@query(
    "C1_mode_multiply",
    f"""WITH {SALES}
SELECT s.i0 AS i0, s.i2 AS i1, b.i1 AS i2, sum(s.value * b.value) AS value
FROM s JOIN bsize b ON s.i1 = b.i0 GROUP BY 1, 2, 3""",
)
def _(spark, d):
    t, b = tb.sales_tensor(spark, d), tb.brand_sizes(spark, d)
    return products.mode_multiply(t, 1, b, 0).frame


@query(
    "C1_mode_multiply_narrow",
    f"""WITH {EVENTS}
SELECT e.i0 AS i0, e.i1 AS i1, c.k AS i2, round(sum(e.value * c.value), 4) AS value
FROM e JOIN (SELECT i2, i1 AS k, sum(value) AS value FROM ecount GROUP BY 1, 2) c ON e.i2 = c.i2
GROUP BY 1, 2, 3""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    counts = tb.event_counts(spark, d, t.shape)
    by_day = construct.from_coo(counts.frame, ["i2", "i1"], "value", (t.shape[2], t.shape[1]))
    return _rounded(products.mode_multiply(t, 2, by_day, 0), 4)


@query(
    "C2_mode_multiply_vec",
    f"""WITH {SALES}, w AS (SELECT i0, value FROM bsize WHERE i1 = 1)
SELECT s.i0 AS i0, s.i2 AS i1, sum(s.value * coalesce(w.value, 0)) AS value
FROM s LEFT JOIN w ON s.i1 = w.i0 GROUP BY 1, 2""",
)
def _(spark, d):
    t = tb.sales_tensor(spark, d)
    # Parts of the least size: brands that have none lack a cell in the vector.
    least = modes.column(tb.brand_sizes(spark, d), 1).frame
    return products.mode_multiply_vec(t, 1, construct.from_vector(least, "i0", "value", t.shape[1])).frame


@query(
    "C3_matmul",
    f"""WITH {SALES}, a AS (SELECT i0, i1, sum(value) AS value FROM s GROUP BY 1, 2)
SELECT a.i0 AS i0, b.i1 AS i1, sum(a.value * b.value) AS value
FROM a JOIN bsize b ON a.i1 = b.i0 GROUP BY 1, 2""",
)
def _(spark, d):
    sales = tb.sales_tensor(spark, d)
    by_brand = construct.from_coo(sales.frame, ["i0", "i1"], "value", sales.shape[:2])
    return products.matmul(by_brand, tb.brand_sizes(spark, d)).frame


@query(
    "C4_dot",
    f"""WITH {SALES}
SELECT coalesce(sum(a.value * b.value), 0) AS value
FROM (SELECT i1, sum(value) AS value FROM s GROUP BY 1) a
JOIN (SELECT i0, sum(value) AS value FROM bsize GROUP BY 1) b ON a.i1 = b.i0""",
)
def _(spark, d):
    u = construct.from_vector(tb.sales_tensor(spark, d, shaped=False).frame, "i1", "value")
    v = construct.from_vector(tb.brand_sizes(spark, d).frame, "i0", "value")
    return products.dot(u, v)


NEXT_DAY = "nxt AS (SELECT i0, i1, i2 + 1 AS i2, value FROM e)"


def _two_days(spark, d):
    t = tb.events_tensor(spark, d)
    grown = t.shape[:2] + (t.shape[2] + 1,)
    return (
        TensorFrame(t.frame, grown, unique=True),
        TensorFrame(modes.shift_mode(t, 2, 1).frame, grown, unique=True),
    )


@query(
    "C5_elementwise",
    f"""WITH {EVENTS}, {NEXT_DAY}
SELECT i0, i1, i2, greatest(e.value, nxt.value) AS value FROM e JOIN nxt USING (i0, i1, i2)""",
)
def _(spark, d):
    return products.elementwise(*_two_days(spark, d), F.greatest).frame


@query(
    "C6_elementwise_full",
    f"""WITH {EVENTS}, {NEXT_DAY}
SELECT i0, i1, i2, coalesce(e.value, 0) + coalesce(nxt.value, 0) * 2 AS value
FROM e FULL JOIN nxt USING (i0, i1, i2)""",
)
def _(spark, d):
    return products.elementwise_full(*_two_days(spark, d), lambda x, y: x + y * 2).frame


@query(
    "C7_subtract",
    f"""WITH {EVENTS}, {NEXT_DAY}
SELECT i0, i1, i2, coalesce(e.value, 0) - coalesce(nxt.value, 0) AS value
FROM e FULL JOIN nxt USING (i0, i1, i2)""",
)
def _(spark, d):
    t, u = _two_days(spark, d)
    return (t - u).frame


@query(
    "C8_hadamard",
    f"""WITH {SALES},
a AS (SELECT i0, i1, sum(value) AS value FROM s GROUP BY 1, 2),
b AS (SELECT i0, i1, CAST(count(*) AS DOUBLE) AS value FROM s GROUP BY 1, 2)
SELECT i0, i1, a.value * b.value AS value FROM a JOIN b USING (i0, i1)""",
)
def _(spark, d):
    sales = tb.sales_tensor(spark, d, shaped=False).frame
    a = construct.from_coo(sales, ["i0", "i1"], "value")
    b = construct.from_coo(sales.withColumn("one", F.lit(1)), ["i0", "i1"], "one")
    return products.hadamard(a, b).frame


@query(
    "C9_multi_dot",
    f"""WITH {SALES},
a AS (SELECT i1 AS k, sum(value) AS value FROM s GROUP BY 1),
b AS (SELECT i0 AS k, sum(value) AS value FROM bsize GROUP BY 1),
c AS (SELECT i0 AS k, max(value) AS value FROM bsize GROUP BY 1)
SELECT sum(a.value * b.value * c.value) AS value FROM a JOIN b USING (k) JOIN c USING (k)""",
)
def _(spark, d):
    sizes = tb.brand_sizes(spark, d).frame
    a = construct.from_vector(tb.sales_tensor(spark, d, shaped=False).frame, "i1", "value")
    b = construct.from_vector(sizes, "i0", "value")
    c = TensorFrame(sizes.groupBy("i0").agg(F.max("value").alias("value")))
    return products.multi_dot(a, b, c)


@query(
    "C11_index_grid",
    f"""WITH {EVENTS}
SELECT x AS i0, y AS i1, z AS i2
FROM elen, range(elen.n0) a(x), range(elen.n1) b(y), range(elen.n2) c(z)""",
)
def _(spark, d):
    return construct.index_grid(spark, tb.event_shape(spark, d))


# --- aggregates ---------------------------------------------------------------------------


@query("D1_nnz", f"WITH {EVENTS} SELECT count(*) AS nnz FROM e")
def _(spark, d):
    return aggregates.nnz(tb.events_tensor(spark, d, shaped=False))


@query("D2_norm", f"WITH {EVENTS} SELECT round(sqrt(sum(value * value)), 6) AS norm FROM e")
def _(spark, d):
    return aggregates.norm(tb.events_tensor(spark, d, shaped=False)).select(tidy("norm").alias("norm"))


@query(
    "D3_normalize",
    f"""WITH {EVENTS}, u AS (SELECT i0, sum(value) AS value FROM ecount GROUP BY 1)
SELECT i0, round(value / (SELECT sqrt(sum(value * value)) FROM u), 9) AS value FROM u""",
)
def _(spark, d):
    users = construct.from_vector(tb.event_counts(spark, d).frame, "i0", "value")
    return _rounded(aggregates.normalize(users)[0], 9)


WIDE = f"""w AS (SELECT i0 AS idx, {", ".join(f"coalesce(sum(value) FILTER (i1 = {r}), 0) AS f{r}" for r in range(5))}
FROM e GROUP BY i0)"""


def _user_kinds(spark, d):
    return factors.rows_from_columns(tb.events_tensor(spark, d, shaped=False).frame, 5, "i0", "i1")


@query(
    "D4_normalize_columns",
    f"""WITH {EVENTS}, {WIDE}
SELECT idx, {", ".join(f"round(f{r} / (SELECT sqrt(sum(f{r} * f{r})) FROM w), 9) AS f{r}" for r in range(5))} FROM w""",
)
def _(spark, d):
    scaled, _ = factors.normalize_columns(_user_kinds(spark, d), 5)
    return scaled.select("idx", *[tidy(F.col("vec")[r], 9).alias(f"f{r}") for r in range(5)])


@query(
    "D4_column_norms",
    f"""WITH {EVENTS}, {WIDE} """
    + " UNION ALL ".join(f"SELECT {r} AS r, round(sqrt(sum(f{r} * f{r})), 6) AS lam FROM w" for r in range(5)),
)
def _(spark, d):
    _, lam = factors.normalize_columns(_user_kinds(spark, d), 5)
    return lam.select("r", tidy("lam").alias("lam"))


GRAM = f"""SELECT a.i1 AS r, b.i1 AS s, {tidy_sql("sum(a.value * b.value)")} AS value
FROM v a JOIN v b ON a.i0 = b.i0 GROUP BY 1, 2"""


@query("D5_gramian", f"WITH {VECTORS}, g AS ({GRAM}) SELECT CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, value FROM g")
def _(spark, d):
    return factors.gramian(tb.vectors_factor(spark, d), 64).withColumn("value", tidy("value"))


@query(
    "D5_gramian_narrow",
    f"""WITH {EVENTS}, {WIDE} """
    + " UNION ALL ".join(
        f"SELECT {r} AS r, {s} AS s, round(sum(f{r} * f{s}), 4) AS value FROM w" for r in range(5) for s in range(5)
    ),
)
def _(spark, d):
    return factors.gramian(_user_kinds(spark, d), 5).withColumn("value", tidy("value", 4))  # products of cents: 4 decimals are exact


@query(
    "D5_gramian_coo",
    f"""WITH {SALES}, a AS (SELECT i0, i1, sum(value) AS value FROM s GROUP BY 1, 2)
SELECT x.i1 AS i0, y.i1 AS i1, sum(x.value * y.value) AS value
FROM a x JOIN a y ON x.i0 = y.i0 GROUP BY 1, 2""",
)
def _(spark, d):
    sales = tb.sales_tensor(spark, d)
    return factors.gramian_coo(construct.from_coo(sales.frame, ["i0", "i1"], "value", sales.shape[:2])).frame


WEIGHTS = """
w0 AS (SELECT i0 AS idx, sum(value * value) AS w FROM {t} GROUP BY 1),
w1 AS (SELECT i1 AS idx, sum(value * value) AS w FROM {t} GROUP BY 1),
w2 AS (SELECT i2 AS idx, sum(value * value) AS w FROM {t} GROUP BY 1),
weights AS (
  SELECT 0 AS mode, k AS idx, coalesce(w, 0) AS w FROM {lens}, range({lens}.n0) t(k) LEFT JOIN w0 ON idx = k
  UNION ALL
  SELECT 1 AS mode, k AS idx, coalesce(w, 0) AS w FROM {lens}, range({lens}.n1) t(k) LEFT JOIN w1 ON idx = k
  UNION ALL
  SELECT 2 AS mode, k AS idx, coalesce(w, 0) AS w FROM {lens}, range({lens}.n2) t(k) LEFT JOIN w2 ON idx = k)"""
SALES_WEIGHTS = WEIGHTS.format(t="s", lens="slen")
EVENT_WEIGHTS = WEIGHTS.format(t="e", lens="elen")


@query("D6_slice_weights", f"WITH {SALES}, {SALES_WEIGHTS} SELECT mode, idx, w FROM weights")
def _(spark, d):
    return aggregates.slice_weights(tb.sales_tensor(spark, d))


@query("D7_merge_weights", f"WITH {SALES}, {SALES_WEIGHTS} SELECT mode, idx, w FROM weights")
def _(spark, d):
    t = tb.sales_tensor(spark, d)
    cut = t.shape[2] // 2
    old, new = construct.slice_window(t, 2, 0, cut), construct.slice_window(t, 2, cut, t.shape[2])
    return aggregates.merge_weights(aggregates.slice_weights(old), aggregates.slice_weights(new), 2, cut)


@query(
    "D9_all_close",
    f"""WITH {EVENTS}
SELECT 'same' AS test, bool_and(abs(value - (value + 5e-7)) <= 1e-6) AS holds FROM e
UNION ALL SELECT 'apart', bool_and(abs(value - (value + 5e-6)) <= 1e-6) FROM e
UNION ALL SELECT 'absent', bool_and(abs(value) <= 1e-6) FROM e""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d, shaped=False)
    none = TensorFrame(t.frame.where("value < 0"), t.shape, unique=True)
    others = [
        ("same", modes.map_entries(t, lambda c, v: v + 5e-7)),
        ("apart", modes.map_entries(t, lambda c, v: v + 5e-6)),
        ("absent", none),
    ]
    rows = [aggregates.all_close(t, u).select(F.lit(name).alias("test"), "holds") for name, u in others]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- order and set operations ---------------------------------------------------------------


@query("E5_sort_by_mode", f"WITH {EVENTS} SELECT {CELLS3} FROM e ORDER BY i2, i0, i1")
def _(spark, d):
    from gridloom.operators.sampling import sort_by_mode

    return sort_by_mode(tb.events_tensor(spark, d, shaped=False), 2)


@query(
    "F1_mode_append",
    f"""WITH {EVENTS}
SELECT {CELLS3} FROM e UNION ALL SELECT i0, i1, i2 + n2 AS i2, value FROM ecount, elen""",
)
def _(spark, d):
    t = tb.events_tensor(spark, d)
    return append.mode_append(t, tb.event_counts(spark, d, t.shape), 2).frame
