"""Private counts, sums, means, variances and standard deviations.

One shape for all: bound the contributions, aggregate moments with partial + final hash aggregation,
complete the public keys, add noise to the one row per key, and derive the answers from the noisy
moments. The sensitivities follow from the bounds and never from the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.calibration import release_chance, scale_for, selection_threshold
from hushframe.functions.noise import Draw, Noise
from hushframe.functions.scalars import check_bounds, clamp, grid_steps
from hushframe.operators.bounding import (
    RANK,
    ROW,
    PrivacyUnit,
    bound_contributions,
    contributed_partitions,
    known_units,
    one_value_each,
)
from hushframe.operators.keysets import aggregate_on_keyset, private_rows

METRICS = ("count", "privacy_id_count", "sum", "mean", "variance", "std")

# Noisy moments that each metric needs; the metric's budget is split evenly over them.
MOMENTS = {
    "count": ("rows",),
    "privacy_id_count": ("ids",),
    "sum": ("sum",),
    "mean": ("n", "m1"),
    "variance": ("n", "m1", "m2"),
    "std": ("n", "m1", "m2"),
}


def dp_aggregate(
    df: DataFrame,
    metrics: Sequence[str],
    epsilon: float,
    noise: Noise,
    *,
    value: Column | str | None = None,
    low: float | None = None,
    high: float | None = None,
    by: Sequence[str] = (),
    keyset: DataFrame | None = None,
    selection: tuple[float, float] | None = None,
    unit: PrivacyUnit = ROW,
    weights: Mapping[str, float] | None = None,
    ddof: int = 0,
    count_mechanism: str = "geometric",
    grid: float | None = None,
) -> DataFrame:
    """Several private metrics per group from one pass over the table.

    ``epsilon`` is shared by the metrics in proportion to ``weights``. Groups come from a public
    ``keyset``; without one, ``selection = (epsilon, delta)`` pays for releasing keys that are found
    in the private data. With ``grid``, sums are whole multiples of the grid step under integer
    noise, which is exact in any order of summation.
    """
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    if by and keyset is None and selection is None:
        raise ValueError("groups need a public keyset or a selection budget (epsilon, delta)")
    if by and keyset is None and unit.column is None and unit.rows > 1:
        raise ValueError("found keys need a privacy unit column when one person has several rows")
    if "privacy_id_count" in metrics and unit.column is None:
        raise ValueError("privacy_id_count needs a privacy unit column")
    bounded_metrics = [m for m in metrics if m not in ("count", "privacy_id_count")]
    if count_mechanism not in ("geometric", "laplace"):
        raise ValueError(f"counts are calibrated for geometric and laplace noise, not for {count_mechanism}")
    if bounded_metrics:
        if value is None or low is None or high is None:
            raise ValueError(f"{bounded_metrics} need value, low and high")
        check_bounds(low, high)

    shares = _split(metrics, epsilon, weights)
    exact = _moments(df, metrics, value, low, high, by, keyset, selection, unit, grid)
    draws = _draws(metrics, shares, low, high, by, unit, count_mechanism, grid)
    found_keys = bool(by) and keyset is None
    if found_keys:
        partitions = unit.partitions if unit.column else 1
        draws.append(Draw("selected_ids", "laplace", scale_for(float(partitions), selection[0])))
    keep = F.col("selected_ids") >= F.lit(selection_threshold(*selection, partitions)) if found_keys else None
    noisy = noise.add(exact, draws, by, keep)
    return noisy.select(*by, *[_answer(m, low, high, ddof).alias(m) for m in metrics])


def _split(metrics: Sequence[str], epsilon: float, weights: Mapping[str, float] | None) -> dict[str, float]:
    weights = {m: (weights or {}).get(m, 1.0) for m in metrics}
    total = sum(weights.values())
    return {m: epsilon * w / total for m, w in weights.items()}


def _moments(df, metrics, value, low, high, by, keyset, selection, unit, grid) -> DataFrame:
    """Exact bounded moments, one row per key, named ``<metric>_<moment>``."""
    v = F.col(value) if isinstance(value, str) else value
    needed = [*by] if unit.column is None else [*by, unit.column, *unit.row_key]
    clamped = (F.lit(None).cast("double") if value is None else clamp(v, low, high)).alias("_value")
    df = df.select(*dict.fromkeys(needed), clamped)
    if unit.column is not None and unit.rows == 1:
        df = one_value_each(df, "_value", unit, by, keyset)
    elif unit.column is not None:
        df = bound_contributions(df, unit, by, keyset)

    on_keyset = bool(by) and keyset is not None
    rows = private_rows() if on_keyset else F.count(F.lit(1))
    x = F.col("_value")
    columns = {"rows": rows, "ids": F.count(F.when(F.col(RANK) == 1, 1)) if unit.column else rows}
    zeros = {"rows": 0, "ids": 0, "n": 0, "sum": Decimal(0) if grid else 0.0, "m1": 0.0, "m2": 0.0}
    if value is not None:
        centred = x - F.lit((low + high) / 2.0)
        columns |= {"n": F.count(x), "m1": F.sum(centred), "m2": F.sum(centred * centred)}
        if grid:
            columns["sum"] = F.sum(grid_steps(x, grid)).cast("decimal(38,0)")
        else:
            columns["sum"] = F.sum(x)
    aggregates = {}
    for metric in metrics:
        for moment in MOMENTS[metric]:
            aggregates[f"{metric}_{moment}"] = F.coalesce(columns[moment], F.lit(zeros[moment]))
    if selection is not None and not on_keyset:
        aggregates["selected_ids"] = columns["ids"]
    if on_keyset:
        used = [c for c in (*by, "_value", RANK) if c in df.columns]
        return aggregate_on_keyset(df.select(*used), keyset, by, aggregates)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


def _draws(metrics, shares, low, high, by, unit, count_mechanism, grid) -> list[Draw]:
    partitions = unit.partitions if by and unit.column else 1
    influence = partitions * unit.rows
    draws = []
    for metric in metrics:
        moments = MOMENTS[metric]
        epsilon = shares[metric] / len(moments)
        for moment in moments:
            name = f"{metric}_{moment}"
            mechanism, sensitivity = "laplace", float(influence)
            if moment in ("rows", "n"):
                mechanism = count_mechanism
            elif moment == "ids":
                mechanism, sensitivity = count_mechanism, float(partitions)
            elif moment == "sum":
                sensitivity *= max(abs(low), abs(high))
            elif moment == "m1":
                sensitivity *= (high - low) / 2.0
            elif moment == "m2":
                sensitivity *= ((high - low) / 2.0) ** 2
            if moment == "sum" and grid:
                steps = influence * math.ceil(max(abs(low), abs(high)) / grid)
                draws.append(Draw(name, "geometric", scale_for(float(steps), epsilon), grid))
            else:
                draws.append(Draw(name, mechanism, scale_for(sensitivity, epsilon)))
    return draws


def _answer(metric: str, low: float | None, high: float | None, ddof: int) -> Column:
    """The metric from its noisy moments, clipped to the range that any data could give."""
    if metric in ("count", "privacy_id_count", "sum"):
        return F.col(f"{metric}_{MOMENTS[metric][0]}")
    n = F.greatest(F.col(f"{metric}_n").cast("double"), F.lit(1.0))
    shift = F.col(f"{metric}_m1") / n
    if metric == "mean":
        middle = F.lit((low + high) / 2.0)
        return F.greatest(F.least(middle + shift, F.lit(float(high))), F.lit(float(low)))
    spread = F.col(f"{metric}_m2") / n - shift * shift
    most = ((high - low) / 2.0) ** 2
    variance = F.greatest(F.least(spread, F.lit(most)), F.lit(0.0))
    if ddof:
        variance = variance * n / F.greatest(n - F.lit(float(ddof)), F.lit(1.0))
    return F.sqrt(variance) if metric == "std" else variance


def dp_count(df: DataFrame, epsilon: float, noise: Noise, **options) -> DataFrame:
    """Private row count; ``by`` + ``keyset`` for groups."""
    return dp_aggregate(df, ["count"], epsilon, noise, **options)


def dp_filtered_count(df: DataFrame, predicate: str, epsilon: float, noise: Noise, **options) -> DataFrame:
    """Private count of the rows that satisfy a SQL predicate."""
    return dp_count(df.filter(predicate), epsilon, noise, **options)


def dp_count_nonzero(
    df: DataFrame, what: Column | str, epsilon: float, noise: Noise, *, n: int | None = None, **options
) -> DataFrame:
    """Private count of non-zero values (or true predicates; NULL and NaN are neither), as a share if the public n is given."""
    c = F.col(what) if isinstance(what, str) else what
    hit = c.cast("double")
    counted = dp_count(df.filter(hit.isNotNull() & ~F.isnan(hit) & (hit != 0)), epsilon, noise, **options)
    return counted.withColumn("share", F.col("count") / F.lit(float(n))) if n else counted


def dp_group_count(
    df: DataFrame, keyset: DataFrame, keys: Sequence[str], budget: float, noise: Noise, *,
    measure: str = "pure", unit: PrivacyUnit = ROW,
) -> DataFrame:
    """Private count per public key: geometric noise, or discrete Gaussian under zCDP."""
    if measure == "pure":
        return dp_count(df, budget, noise, by=keys, keyset=keyset, unit=unit)
    exact = _moments(df, ["count"], None, None, None, keys, keyset, None, unit, None)
    sensitivity = unit.rows * unit.partitions**0.5 if unit.column else float(unit.rows)
    draw = Draw("count_rows", "discrete_gaussian", scale_for(sensitivity, budget, measure))
    return noise.add(exact, [draw], keys).withColumnRenamed("count_rows", "count")


def dp_privacy_id_count(
    df: DataFrame, unit: PrivacyUnit, epsilon: float, noise: Noise, *,
    by: Sequence[str] = (), keyset: DataFrame | None = None,
) -> DataFrame:
    """Private number of distinct privacy units per partition.

    Counts the bounded distinct pairs, so there is no second de-duplication per group.
    """
    if by and keyset is None:
        raise ValueError("groups need a public keyset; use select_partitions for found keys")
    if by:
        pairs = contributed_partitions(df, unit, by, keyset).select(*by)
        exact = aggregate_on_keyset(pairs, keyset, by, {"privacy_id_count": private_rows()})
    else:
        exact = known_units(df, unit).select(unit.column).distinct().agg(F.count(F.lit(1)).alias("privacy_id_count"))
    partitions = unit.partitions if by else 1
    draw = Draw("privacy_id_count", "geometric", scale_for(float(partitions), epsilon))
    return noise.add(exact, [draw], by)


def select_partitions(
    df: DataFrame, unit: PrivacyUnit, by: Sequence[str], epsilon: float, delta: float, noise: Noise
) -> DataFrame:
    """Keys found in private data whose noisy number of units reaches the threshold for delta."""
    if unit.column is None:
        raise ValueError("selecting keys needs a privacy unit column")
    pairs = contributed_partitions(df, unit, by)
    exact = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("noisy_ids"))
    draw = Draw("noisy_ids", "laplace", scale_for(float(unit.partitions), epsilon))
    threshold = selection_threshold(epsilon, delta, unit.partitions)
    return noise.add(exact, [draw], by, F.col("noisy_ids") >= F.lit(threshold))


def select_partitions_optimal(
    df: DataFrame, unit: PrivacyUnit, by: Sequence[str], epsilon: float, delta: float, noise: Noise
) -> DataFrame:
    """Keys found in private data, each released by a coin with the largest chance that its number of units allows.

    More keys are released than by a noisy count against a threshold, but no count: only the keys. A NULL key is a key.
    """
    if unit.column is None:
        raise ValueError("selecting keys needs a privacy unit column")
    chance = release_chance("_ids", epsilon, delta, unit.partitions)
    pairs = contributed_partitions(df, unit, by)
    exact = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_ids"))
    return noise.settle(exact.filter(noise.coin("selected", by, chance)).select(*by))


def dp_sum(
    df: DataFrame, c: Column | str, low: float, high: float, epsilon: float, noise: Noise, **options
) -> DataFrame:
    """Private sum of clamped values; NULL and NaN are skipped."""
    return dp_aggregate(df, ["sum"], epsilon, noise, value=c, low=low, high=high, **options)


def dp_mean(
    df: DataFrame, c: Column | str, low: float, high: float, epsilon: float, noise: Noise, **options
) -> DataFrame:
    """Private mean when the number of rows is private too."""
    return dp_aggregate(df, ["mean"], epsilon, noise, value=c, low=low, high=high, **options)


def dp_variance(
    df: DataFrame, c: Column | str, low: float, high: float, epsilon: float, noise: Noise, **options
) -> DataFrame:
    """Private variance when the number of rows is private too."""
    return dp_aggregate(df, ["variance"], epsilon, noise, value=c, low=low, high=high, **options)


def dp_std(
    df: DataFrame, c: Column | str, low: float, high: float, epsilon: float, noise: Noise, **options
) -> DataFrame:
    """Private standard deviation: the root of the private variance."""
    return dp_aggregate(df, ["std"], epsilon, noise, value=c, low=low, high=high, **options)
