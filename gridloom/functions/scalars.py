"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two numbers this near each other count as the same.
EPSILON = 1e-7


def is_close(a: Column, b: Column | float, tol: float = EPSILON) -> Column:
    """Absolute closeness: ``|a - b| <= tol``."""
    other = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs(a - other) <= F.lit(float(tol))


def is_zero(a: Column, tol: float = EPSILON) -> Column:
    return F.abs(a) <= F.lit(float(tol))


def sign_of(a: Column) -> Column:
    """+1 for zero and above, -1 below (there is no zero sign)."""
    return F.when(a >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def ratio(a: Column, b: Column) -> Column:
    """Division that leaves a zero divisor at 0 instead of raising in ANSI mode."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def required(col: Column, message: str, kind: str) -> Column:
    """The column, failing the job when a null turns up."""
    return F.coalesce(col, F.raise_error(F.lit(message)).cast(kind))


def hash_uniform(*parts: Column | int | str) -> Column:
    """Uniform number in (0, 1) fixed by its key, whatever the partitioning.

    The first 12 hex digits of the md5 of the key give 48 bits; the half step
    keeps the result away from both ends.
    """
    key = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    digits = F.conv(F.substring(F.md5(key), 1, 12), 16, 10)
    return (digits.cast("bigint") + F.lit(0.5)) / F.lit(float(16**12))


def hash_normal(*parts: Column | int | str) -> Column:
    """Standard normal number fixed by its key (polar form of two uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(hash_uniform(*parts, "radius")))
    return radius * F.cos(F.lit(2.0 * math.pi) * hash_uniform(*parts, "angle"))
