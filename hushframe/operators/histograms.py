"""Private histograms in one or more dimensions, and quantiles on a public grid."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.calibration import scale_for
from hushframe.functions.noise import Draw, Noise
from hushframe.functions.scalars import check_bounds
from hushframe.operators.bounding import ROW, PrivacyUnit, bound_contributions, bound_rows
from hushframe.operators.keysets import aggregate_on_keyset, keyset_product, private_rows
from hushframe.operators.matching import null_safe_join
from hushframe.operators.private import select_partitions

#: Bins that share a block of the running sums.
BLOCK = 4096


@dataclass(frozen=True)
class Axis:
    """Equal-width bins over [low, high]; the last bin is closed, values outside are not counted."""

    column: str
    low: float
    high: float
    bins: int

    def __post_init__(self) -> None:
        check_bounds(self.low, self.high)
        if self.bins < 1:
            raise ValueError("an axis needs at least one bin")

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.bins

    def index(self) -> Column:
        v = F.col(self.column).cast("double")
        at = F.floor((v - F.lit(float(self.low))) / F.lit(self.width))
        inside = (v >= F.lit(float(self.low))) & (v <= F.lit(float(self.high)))
        return F.when(inside, F.least(at, F.lit(self.bins - 1)).cast("bigint"))


def cells_of(df: DataFrame, axes: Sequence[Axis], by: Sequence[str] = ()) -> DataFrame:
    """The cell ``bin_0``, ``bin_1``, ... of each row that lies on the grid."""
    names = [f"bin_{i}" for i in range(len(axes))]
    return df.select(*by, *[a.index().alias(n) for a, n in zip(axes, names)]).dropna(subset=names)


def full_grid(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Every cell, read off a running number, so that no two axes are ever joined."""
    cells = math.prod(a.bins for a in axes)
    if cells >= 1 << 63:
        raise ValueError(f"{cells} cells cannot be numbered; use dp_sparse_histogram")
    columns, stride = [], cells
    for i, axis in enumerate(axes):
        stride //= axis.bins
        columns.append((F.floor(F.col("id") / F.lit(stride)) % F.lit(axis.bins)).cast("bigint").alias(f"bin_{i}"))
    return df.sparkSession.range(cells).select(*columns)


def dp_histogramdd(
    df: DataFrame, axes: Sequence[Axis], epsilon: float, noise: Noise, *,
    unit: PrivacyUnit = ROW, n: int | None = None,
) -> DataFrame:
    """Private counts of all cells, empty ones included, with the lower edge of each bin.

    A unit with an id counts with at most ``unit.rows`` rows in the whole histogram. With the public n the
    counts are given as frequencies as well.
    """
    names = [f"bin_{i}" for i in range(len(axes))]
    if unit.column is not None:
        df = bound_rows(df, unit)
    exact = aggregate_on_keyset(cells_of(df, axes), full_grid(df, axes), names, {"count": private_rows()})
    noisy = noise.add(exact, [Draw("count", "geometric", scale_for(float(unit.rows), epsilon))], names)
    edges = {
        f"edge_{i}": F.lit(float(a.low)) + F.col(f"bin_{i}") * F.lit(a.width) for i, a in enumerate(axes)
    }
    noisy = noisy.withColumns(edges)
    return noisy.withColumn("frequency", F.col("count") / F.lit(float(n))) if n else noisy


def dp_histogram(
    df: DataFrame, c: str, low: float, high: float, bins: int, epsilon: float, noise: Noise, **options
) -> DataFrame:
    """Private counts of equal bins of one column."""
    return dp_histogramdd(df, [Axis(c, low, high, bins)], epsilon, noise, **options)


def dp_histogram2d(
    df: DataFrame, first: Axis, second: Axis, epsilon: float, noise: Noise, **options
) -> DataFrame:
    """Private counts of the cells of two columns."""
    return dp_histogramdd(df, [first, second], epsilon, noise, **options)


def dp_sparse_histogram(
    df: DataFrame, axes: Sequence[Axis], unit: PrivacyUnit, epsilon: float, delta: float, noise: Noise
) -> DataFrame:
    """Found cells of a grid that is too large to list: paid for with delta."""
    names = [f"bin_{i}" for i in range(len(axes))]
    cells = cells_of(df, axes, [unit.column])
    return select_partitions(cells, unit, names, epsilon, delta, noise)


def dp_quantiles(
    df: DataFrame, axis: Axis, quantiles: Sequence[float], epsilon: float, noise: Noise, *,
    by: Sequence[str] = (), keyset: DataFrame | None = None, unit: PrivacyUnit = ROW,
) -> DataFrame:
    """Private quantiles by the exponential mechanism over a public bin grid.

    Only bin counts are ordered, never rows: running sums are taken inside blocks of bins and over the
    sums of the blocks, so a fine grid is spread over many tasks. A bin scores by how far the rank at its middle is from the wanted rank; the value is drawn inside the
    chosen bin. Empty bins take part, as leaving them out would reveal where the data lies.
    """
    for q in quantiles:
        if not 0 <= q <= 1:
            raise ValueError(f"quantile {q} is not between 0 and 1")
    if by and keyset is None:
        raise ValueError("groups need a public keyset")
    influence = unit.rows
    if unit.column is not None:
        df = bound_contributions(df, unit, by, keyset)
        influence *= unit.partitions if by else 1
    grid = full_grid(df, [axis])
    if by:
        grid = keyset_product(keyset.select(*by), grid)
    cells = cells_of(df, [axis], by)
    counts = aggregate_on_keyset(cells, grid, [*by, "bin_0"], {"count": private_rows()})
    counts = counts.withColumn("_block", F.floor(F.col("bin_0") / F.lit(BLOCK)))
    sums = counts.groupBy(*by, "_block").agg(F.sum("count").alias("_sum"))
    group = Window.partitionBy(*by)
    earlier = F.sum("_sum").over(group.orderBy("_block")) - F.col("_sum")
    sums = sums.select(*by, "_block", earlier.alias("_earlier"), F.sum("_sum").over(group).alias("n"))
    inside = F.sum("count").over(Window.partitionBy(*by, "_block").orderBy("bin_0"))
    upto = F.col("_earlier") + F.col("_inside")
    ranked = null_safe_join(counts.withColumn("_inside", inside), sums, [*by, "_block"])
    ranked = ranked.select(*by, "bin_0", (upto - F.col("count") / 2.0).alias("rank"), "n")
    asked = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    scored = ranked.withColumn("quantile", asked)
    share = epsilon / (len(quantiles) * influence)
    score = -F.abs(F.col("rank") - F.col("quantile") * F.col("n"))
    gumbel = noise.uniform("gumbel", [*by, "quantile_text", "bin_0"])
    inside = noise.uniform("inside", [*by, "quantile_text"])
    scored = scored.withColumn("quantile_text", F.format_number("quantile", 6))
    utility = F.lit(share / 2.0) * score + F.lit(math.log(axis.width)) - F.log(-F.log(gumbel))
    best = scored.withColumn("utility", utility).groupBy(*by, "quantile", "quantile_text").agg(
        F.max_by("bin_0", "utility").alias("bin_0")
    )
    value = F.lit(float(axis.low)) + (F.col("bin_0") + inside) * F.lit(axis.width)
    return noise.settle(best.select(*by, "quantile", value.alias("value")))


def dp_median(df: DataFrame, axis: Axis, epsilon: float, noise: Noise, **options) -> DataFrame:
    """The private median, overall or per group."""
    return dp_quantiles(df, axis, [0.5], epsilon, noise, **options)


def dp_percentiles(
    df: DataFrame, axis: Axis, percents: Sequence[float], epsilon: float, noise: Noise, **options
) -> DataFrame:
    """Private quantiles, asked for in percent."""
    return dp_quantiles(df, axis, [p / 100.0 for p in percents], epsilon, noise, **options)
