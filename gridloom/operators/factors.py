"""Factor tables: ``(idx bigint, vec array<double>)``, or flat ``(idx, f0, f1, ...)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import ratio, sign_of
from gridloom.operators.products import PACK_WIDTH, mode_multiply
from gridloom.tensor import TensorFrame, derive_shape

# Up to this rank all products of a Gram matrix are columns of one aggregate;
# beyond it code generation would give up on the row width.
GRAM_COLUMNS = 12


def flat_cols(rank: int, prefix: str = "f") -> list[str]:
    return [f"{prefix}{r}" for r in range(rank)]


def unpack(factor: DataFrame, rank: int, prefix: str = "f") -> DataFrame:
    """Array form to flat form; other columns are kept in front."""
    keep = [c for c in factor.columns if c != "vec"]
    return factor.select(
        *keep, *[F.col("vec")[r].alias(c) for r, c in enumerate(flat_cols(rank, prefix))]
    )


def pack(flat: DataFrame, rank: int, prefix: str = "f") -> DataFrame:
    """Flat form to array form; other columns are kept in front."""
    cols = flat_cols(rank, prefix)
    keep = [c for c in flat.columns if c not in cols]
    return flat.select(*keep, F.array(*cols).alias("vec"))


def rows_from_columns(matrix: DataFrame, rank: int, idx: str = "idx", r: str = "r", value: str = "value") -> DataFrame:
    """Rows ``(idx, vec)`` from cells ``(idx, r, value)``; absent columns become 0, and a
    column outside 0..rank-1 fails the job."""
    outside = F.raise_error(F.concat(F.lit(f"column outside 0..{rank - 1}: "), F.col(r).cast("string")))
    inside = F.when((F.col(r) >= 0) & (F.col(r) < rank), F.col(value)).otherwise(outside.cast("double"))
    matrix = matrix.select(F.col(idx).alias(idx), F.col(r).alias(r), inside.alias(value))
    cols = [
        F.coalesce(F.sum(F.when(F.col(r) == k, F.col(value))), F.lit(0.0)).alias(f"f{k}")
        for k in range(rank)
    ]
    return pack(matrix.groupBy(F.col(idx).alias("idx")).agg(*cols), rank)


def from_columns(vectors: Sequence[TensorFrame]) -> TensorFrame:
    """Matrix from column vectors: each tagged with its column number."""
    frame = None
    for c, v in enumerate(vectors):
        part = v.frame.select("i0", F.lit(c).cast("bigint").alias("i1"), "value")
        frame = part if frame is None else frame.unionByName(part)
    shape = derive_shape(lambda *s: (max(n[0] for n in s), len(s)), *vectors)
    return TensorFrame(frame, shape, all(v.unique for v in vectors))


def complete(factor: DataFrame, length: int, rank: int) -> DataFrame:
    """Zero rows for the indexes of 0..length-1 that have none."""
    zeros = F.array(*[F.lit(0.0)] * rank)
    slots = factor.sparkSession.range(length).select(F.col("id").alias("idx"))
    return slots.join(factor.select("idx", "vec"), "idx", "left").select(
        "idx", F.coalesce("vec", zeros).alias("vec")
    )


def normalize_columns(factor: DataFrame, rank: int) -> tuple[DataFrame, DataFrame]:
    """Columns scaled to length 1, and their norms ``(r, lam)``: one aggregate for all."""
    flat = unpack(factor, rank)
    norms = flat.agg(
        F.array(*[F.sqrt(F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0))) for c in flat_cols(rank)]).alias("lam")
    )
    length = norms.scalar()
    scaled = flat.select(
        "idx",
        F.array(*[ratio(F.col(c), length[r]) for r, c in enumerate(flat_cols(rank))]).alias("vec"),
    )
    return scaled, norms.select(F.posexplode("lam").alias("r", "lam"))


def upper_pairs(rank: int) -> list[tuple[int, int]]:
    return [(r, s) for r in range(rank) for s in range(r, rank)]


def gram_sums(rank: int, prefix: str = "f"):
    """The upper half of the Gram matrix as aggregate columns ``g_r_s``."""
    return [
        F.expr(f"coalesce(sum({prefix}{r} * {prefix}{s}), 0D) as g_{r}_{s}")
        for r, s in upper_pairs(rank)
    ]


def gramian(factor: DataFrame, rank: int) -> DataFrame:
    """Gram matrix of a factor table as ``(r, s, value)``; rows are not shuffled.

    Narrow factors: all products in one global aggregate.  Wider ones: every row
    is unfolded by its column number, which gives ``rank`` groups of ``rank`` sums,
    reduced in each task before anything moves.
    """
    flat = unpack(factor, rank)
    if rank <= GRAM_COLUMNS:
        cells = F.array(
            *[
                F.struct(F.lit(r).alias("r"), F.lit(s).alias("s"), F.col(f"g_{min(r, s)}_{max(r, s)}").alias("value"))
                for r in range(rank)
                for s in range(rank)
            ]
        )
        return flat.agg(*gram_sums(rank)).select(F.inline(cells))
    cols = flat_cols(rank)
    unfolded = flat.select(*cols, F.posexplode(F.array(*cols)).alias("r", "x"))
    sums = unfolded.groupBy("r").agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in cols])
    return sums.select("r", F.posexplode(F.array(*cols)).alias("s", "value"))


def gramian_coo(matrix: TensorFrame) -> TensorFrame:
    """Gram matrix of a matrix in coordinate form.

    With few columns the rows are gathered into flat rows first, so a row is met
    once; otherwise it is the contraction of the row mode with itself.
    """
    width = matrix.known_shape[1] if matrix.known_shape else None
    if width is None or width > PACK_WIDTH:
        return mode_multiply(matrix, 0, matrix, 0)
    cols = flat_cols(width)
    rows = matrix.frame.groupBy("i0").agg(
        *[F.sum(F.when(F.col("i1") == c, F.col("value"))).alias(name) for c, name in enumerate(cols)]
    )
    unfolded = rows.select(*cols, F.posexplode(F.array(*cols)).alias("r", "x")).where("x is not null")
    sums = unfolded.groupBy("r").agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in cols])
    cells = sums.select(
        F.col("r").cast("bigint").alias("i0"), F.posexplode(F.array(*cols)).alias("i1", "value")
    ).where("value is not null")
    cells = cells.select("i0", F.col("i1").cast("bigint").alias("i1"), "value")
    return TensorFrame(cells, (width, width), unique=True)


def sign_agreement(factor: DataFrame, reference: DataFrame, rank: int) -> DataFrame:
    """``(r, sign)``: +1 where the signs of a column agree with the reference in at
    least as many rows as they disagree, else -1; zero counts as positive."""
    met = unpack(factor, rank).join(unpack(reference, rank, "g"), "idx")
    sums = met.agg(
        F.array(
            *[
                sign_of(F.coalesce(F.sum(sign_of(F.col(f"g{r}")) * sign_of(F.col(f"f{r}"))), F.lit(0.0)))
                for r in range(rank)
            ]
        ).alias("signs")
    )
    return sums.select(F.posexplode("signs").alias("r", "sign"))


def mean_factors(by_rep: DataFrame, rank: int, reps: int) -> DataFrame:
    """Rows averaged over repetitions, from ``(rep, idx, vec)``; a row a repetition
    does not have counts as zero."""
    flat = unpack(by_rep, rank)
    sums = flat.groupBy("idx").agg(
        *[(F.sum(c) / F.lit(float(reps))).alias(c) for c in flat_cols(rank)]
    )
    return pack(sums, rank)
