"""Synthetic private tables: skew-normal samples and demographics, drawn row by row from keyed hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.uniform import uniform

# The scales and skews of the one-column samples.
SCALES = [50, 250, 500]
SKEWS = [0, 5, 50]

# Rational approximation of the inverse normal distribution function (Acklam).
CENTRE_TOP = [
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
]
CENTRE_BOTTOM = [
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
]
TAIL_TOP = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
]
TAIL_BOTTOM = [
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
]
TAIL = 0.02425


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def inverse_normal(p: Column) -> Column:
    """The standard normal value below which a share ``p`` lies."""
    centred = p - F.lit(0.5)
    square = centred * centred
    centre = centred * _polynomial(CENTRE_TOP, square) / _polynomial(CENTRE_BOTTOM, square)

    def tail(share: Column) -> Column:
        x = F.sqrt(F.lit(-2.0) * F.log(share))
        return _polynomial(TAIL_TOP, x) / _polynomial(TAIL_BOTTOM, x)

    return (
        F.when(p < F.lit(TAIL), tail(p))
        .when(p > F.lit(1.0 - TAIL), -tail(F.lit(1.0) - p))
        .otherwise(centre)
    )


def _cents(value: Column) -> Column:
    """Two digits, half to even; cheaper per row than the decimal rounding of ``bround``."""
    return F.rint(value * F.lit(100.0)) / F.lit(100.0)


def skew_normal(
    seed: str | int, scale: Column | float, skew: Column | float, *key: Column | str, algorithm: str = "xxhash64"
) -> Column:
    """Skew-normal value around 0 (Azzalini 1985), rounded half-even to cents."""
    u1 = uniform(seed, F.lit("z1"), *key, algorithm=algorithm)
    u2 = uniform(seed, F.lit("z2"), *key, algorithm=algorithm)
    radius, angle = F.sqrt(F.lit(-2.0) * F.log(u1)), F.lit(2.0 * math.pi) * u2
    size, shape = (x if isinstance(x, Column) else F.lit(float(x)) for x in (scale, skew))
    share = shape / F.sqrt(F.lit(1.0) + shape * shape)
    rest = F.sqrt(F.lit(1.0) - share * share)
    return _cents(size * (share * F.abs(radius * F.cos(angle)) + rest * radius * F.sin(angle)))


def truncated_normal(u: Column, mean: float, deviation: float, low: float, high: float) -> Column:
    """Normal value limited to [low, high], by inverse distribution function."""
    law = NormalDist()
    start, stop = law.cdf((low - mean) / deviation), law.cdf((high - mean) / deviation)
    inside = F.lit(start) + u * F.lit(stop - start)
    value = F.lit(float(mean)) + F.lit(float(deviation)) * inverse_normal(inside)
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def demographics(seed: str | int, *key: Column | str, algorithm: str = "xxhash64") -> dict[str, Column]:
    """Age 0..120, height 50..200 in cents of a unit, income normal(0, 5000) within 3000..15000."""
    def u(what: str) -> Column:
        return uniform(seed, F.lit(what), *key, algorithm=algorithm)

    return {
        "age": F.floor(u("age") * F.lit(121.0)).cast("int"),
        "height": _cents(F.lit(50.0) + u("height") * F.lit(150.0)),
        "income": truncated_normal(u("income"), 0.0, 5000.0, 3000.0, 15000.0),
    }


def skew_normal_table(
    spark: SparkSession, n: int, scale: float, skew: float, seed: str | int, algorithm: str = "xxhash64"
) -> DataFrame:
    """n rows of one column ``values``; each row depends on its number only, so tasks may be re-run."""
    return skew_normal_datasets(spark, n, seed, [scale], [skew], algorithm).select("values")


def skew_normal_datasets(
    spark: SparkSession, n: int, seed: str | int,
    scales: Sequence[float] = SCALES, skews: Sequence[float] = SKEWS, algorithm: str = "xxhash64",
) -> DataFrame:
    """All scale and skew settings as one table with the dataset name."""
    settings = F.array(*[
        F.struct(
            F.lit(f"data_{n}_{scale}_{skew}.csv").alias("dataset"),
            F.lit(float(scale)).alias("scale"),
            F.lit(float(skew)).alias("skew"),
        )
        for scale in scales
        for skew in skews
    ])
    rows = spark.range(n).select("id", F.inline(settings))
    value = skew_normal(seed, F.col("scale"), F.col("skew"), "scale", "skew", "id", algorithm=algorithm)
    return rows.select(value.alias("values"), "dataset")


def demographics_table(spark: SparkSession, n: int, seed: str | int, algorithm: str = "xxhash64") -> DataFrame:
    columns = demographics(seed, "id", algorithm=algorithm)
    return spark.range(n).select(*[c.alias(name) for name, c in columns.items()])
