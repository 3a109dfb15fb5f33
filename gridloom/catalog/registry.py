"""Named queries with, where SQL can say the same, the SQL to check them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(col: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    value = F.round(F.col(col) if isinstance(col, str) else col, digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def tidy_sql(expr: str, digits: int = 6) -> str:
    value = f"round({expr}, {digits})"
    return f"(CASE WHEN {value} = 0 THEN 0e0 ELSE {value} END)"


# --- SQL for the shared tensors ---------------------------------------------------

EVENTS = """
kinds AS (
  SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS kind
  FROM (SELECT DISTINCT event_type FROM events)),
e AS (
  SELECT user_id AS i0, kind AS i1,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS i2,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS value
  FROM events JOIN kinds USING (event_type) GROUP BY ALL),
ecount AS (
  SELECT user_id AS i0, kind AS i1,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS i2,
         CAST(count(*) AS DOUBLE) AS value
  FROM events JOIN kinds USING (event_type) GROUP BY ALL),
elen AS (SELECT max(i0) + 1 AS n0, max(i1) + 1 AS n1, max(i2) + 1 AS n2 FROM e)"""

SALES = """
brands AS (
  SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS brand
  FROM (SELECT DISTINCT p_brand FROM part)),
months AS (SELECT min(year(l_shipdate) * 12 + month(l_shipdate)) AS m0 FROM lineitem),
s AS (
  SELECT CAST(c_nationkey AS BIGINT) AS i0, brand AS i1,
         CAST(year(l_shipdate) * 12 + month(l_shipdate) - m0 AS BIGINT) AS i2,
         sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN part ON l_partkey = p_partkey JOIN brands USING (p_brand), months
  GROUP BY ALL),
slen AS (SELECT (SELECT max(c_nationkey) + 1 FROM customer) AS n0,
                (SELECT count(*) FROM brands) AS n1,
                (SELECT max(year(l_shipdate) * 12 + month(l_shipdate)) - min(m0) + 1
                 FROM lineitem, months) AS n2),
bsize AS (
  SELECT brand AS i0, CAST(p_size AS BIGINT) AS i1, CAST(count(*) AS DOUBLE) AS value
  FROM part JOIN brands USING (p_brand) GROUP BY ALL)"""

VECTORS = """
v AS (
  SELECT vec_id AS i0, CAST(pos - 1 AS BIGINT) AS i1, CAST(x AS DOUBLE) AS value
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
        FROM embeddings))"""


def uniform_sql(*parts: str | int) -> str:
    """The uniform number of a key; parts are SQL expressions or whole numbers."""
    key = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return (
        f"((CAST(CAST('0x' || substr(md5(concat_ws('|', {key})), 1, 12) AS BIGINT) AS DOUBLE)"
        f" + 0.5e0) / 281474976710656e0)"
    )


def normal_sql(*parts: str | int) -> str:
    radius = uniform_sql(*parts, "'radius'")
    angle = uniform_sql(*parts, "'angle'")
    return f"(sqrt(-2e0 * ln({radius})) * cos(2e0 * pi() * {angle}))"


def factor_sql(name: str, lens: str, mode: int, rank: int, seed: int, dist: str = "uniform") -> str:
    """CTE ``name(idx, f0, ...)``: random factor rows of one mode."""
    draw = {"uniform": uniform_sql, "normal": normal_sql}[dist]
    cols = ", ".join(f"{draw(seed, mode, 'idx', r)} AS f{r}" for r in range(rank))
    return f"{name} AS (SELECT idx, {cols} FROM {lens}, range({lens}.n{mode}) AS t(idx))"


def flat_rows_sql(rank: int, digits: int = 6, prefix: str = "f", alias: str = "f") -> str:
    return ", ".join(f"{tidy_sql(f'{prefix}{r}', digits)} AS {alias}{r}" for r in range(rank))


def flat_rows(factor: DataFrame, rank: int, digits: int = 6) -> DataFrame:
    """Factor rows for comparison: leading columns, then rounded ``f0..``."""
    keep = [c for c in factor.columns if c != "vec"]
    return factor.select(*keep, *[tidy(F.col("vec")[r], digits).alias(f"f{r}") for r in range(rank)])
