"""Private sums of vectors whose length is clipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.calibration import scale_for
from hushframe.functions.noise import Draw, Noise
from hushframe.operators.bounding import ROW, PrivacyUnit, bound_rows
from hushframe.operators.keysets import aggregate_on_keyset


def usable(c: Column | str, dim: int) -> Column:
    """The first ``dim`` elements as doubles; NULL, NaN and infinite ones count as zero."""
    v = F.col(c) if isinstance(c, str) else c

    def finite(x: Column) -> Column:
        x = x.cast("double")
        return F.coalesce(F.when(F.abs(x) < F.lit(float("inf")), x), F.lit(0.0))

    return F.transform(F.slice(v, 1, dim), finite)


def vector_norm(c: Column | str, norm: str) -> Column:
    """L1 or L2 length of an array of numbers."""
    v = F.col(c) if isinstance(c, str) else c
    if norm == "l1":
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))
    if norm == "l2":
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        return F.sqrt(squares)
    raise ValueError(f"unknown norm: {norm}")


def clip_factor(c: Column | str, norm: str, clip: float) -> Column:
    """What to multiply a vector of usable elements by so that its length is at most ``clip``.

    A length that overflows is infinite, and its vector counts as zero.
    """
    length = vector_norm(c, norm)
    return F.when(length > F.lit(float(clip)), F.lit(float(clip)) / length).otherwise(F.lit(1.0))


def vector_sum(df: DataFrame, c: str, dim: int, clip: float, norm: str = "l2") -> DataFrame:
    """Exact sum of the clipped vectors, one row per coordinate ``pos`` in 0..dim-1.

    Vectors are cut to ``dim`` elements before their length is taken; missing and infinite elements count as
    zero. The partial sums of a task are ``dim`` rows, whatever the number of vectors.
    """
    vectors = df.select(usable(c, dim).alias("_v"))
    scaled = vectors.select("_v", clip_factor("_v", norm, clip).alias("_factor"))
    parts = scaled.select("_factor", F.posexplode("_v").alias("pos", "_x"))
    parts = parts.select("pos", (F.col("_x").cast("double") * F.col("_factor")).alias("_x"))
    grid = df.sparkSession.range(dim).select(F.col("id").cast("int").alias("pos"))
    return aggregate_on_keyset(parts, grid, ["pos"], {"value": F.coalesce(F.sum("_x"), F.lit(0.0))})


def dp_vector_sum(
    df: DataFrame, c: str, dim: int, clip: float, budget: float, noise: Noise, *,
    norm: str = "l2", unit: PrivacyUnit = ROW,
) -> DataFrame:
    """Private vector sum: Laplace noise and epsilon for an L1 clip, Gaussian noise and rho for L2."""
    if unit.column is not None:
        df = bound_rows(df, unit)
    sensitivity = float(unit.rows * clip)
    if norm == "l1":
        draw = Draw("value", "laplace", scale_for(sensitivity, budget))
    else:
        draw = Draw("value", "gaussian", scale_for(sensitivity, budget, "zcdp"))
    return noise.add(vector_sum(df, c, dim, clip, norm), [draw], ["pos"])
