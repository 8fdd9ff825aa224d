"""Noise scales, privacy losses and conversions, one Column expression per plan or ledger row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def _positive(c: Column, what: str) -> Column:
    message = F.concat(F.lit(f"{what} must be positive, got "), F.coalesce(c.cast("string"), F.lit("NULL")))
    return F.when(c > 0, c).otherwise(F.raise_error(message).cast("double"))


def noise_scale(d_in: Column | str | float, d_out: Column | str | float, measure: Column | str) -> Column:
    """Smallest noise for a sensitivity and a budget.

    ``pure``: the Laplace or geometric scale ``d_in / d_out``. ``zcdp``: the Gaussian variance
    ``d_in^2 / (2 d_out)``. A budget of zero or less raises.
    """
    d_in, measure = _col(d_in), _col(measure)
    budget = _positive(_col(d_out).cast("double"), "privacy budget")
    return (
        F.when(measure == "pure", d_in / budget)
        .when(measure == "zcdp", d_in * d_in / (F.lit(2.0) * budget))
        .otherwise(F.raise_error(F.lit("unknown privacy measure")).cast("double"))
    )


def scale_for(sensitivity: float, budget: float, measure: str = "pure") -> float:
    """The same closed form for a single planned query."""
    if not budget > 0:
        raise ValueError(f"privacy budget must be positive, got {budget}")
    if not sensitivity > 0:
        raise ValueError(f"sensitivity must be positive, got {sensitivity}")
    if measure == "pure":
        return sensitivity / budget
    if measure == "zcdp":
        return sensitivity * sensitivity / (2.0 * budget)
    raise ValueError(f"unknown privacy measure: {measure}")


def privacy_loss(mechanism: Column | str, scale: Column | str, d_in: Column | str | float) -> Column:
    """Loss when inputs differ by ``d_in`` units: epsilon, or rho for the Gaussian mechanisms.

    The group privacy of g units is the loss at ``d_in = g``.
    """
    mechanism, scale, d_in = _col(mechanism), _positive(_col(scale), "noise scale"), _col(d_in)
    return (
        F.when(mechanism.isin("laplace", "geometric"), d_in / scale)
        .when(mechanism.isin("gaussian", "discrete_gaussian"), d_in * d_in / (F.lit(2.0) * scale))
        .otherwise(F.raise_error(F.concat(F.lit("unknown mechanism "), mechanism)).cast("double"))
    )


def satisfied(loss: Column | str, limit: Column | str | float) -> Column:
    return _col(loss) <= _col(limit)


def pure_to_zcdp(epsilon: Column | str) -> Column:
    return _col(epsilon) * _col(epsilon) / F.lit(2.0)


def zcdp_to_epsilon(rho: Column | str, delta: Column | str | float) -> Column:
    """The epsilon of (epsilon, delta) that a rho-zCDP spend satisfies."""
    rho, delta = _col(rho), _col(delta)
    return rho + F.lit(2.0) * F.sqrt(rho * F.log(F.lit(1.0) / delta))


def approx_to_zcdp(epsilon: float, delta: float) -> float:
    """The largest rho that satisfies (epsilon, delta): the inverse of ``zcdp_to_epsilon``."""
    if not 0 < delta < 1:
        raise ValueError(f"delta must lie between 0 and 1, got {delta}")
    reach = math.log(1.0 / delta)
    return (math.sqrt(reach + epsilon) - math.sqrt(reach)) ** 2


def advanced_epsilon(epsilons: Sequence[float], slack: float) -> float:
    """Total epsilon of the queries of one session when ``slack`` of delta is given up.

    The smallest of the sum and the two bounds of Kairouz, Oh and Viswanath (2015).
    """
    linear = math.fsum(epsilons)
    if slack <= 0 or not 0 < linear < math.inf:
        return linear
    squares = math.fsum(e * e for e in epsilons)
    drift = math.fsum(e * math.tanh(e / 2.0) for e in epsilons)
    first = drift + math.sqrt(2.0 * squares * math.log(1.0 / slack))
    second = drift + math.sqrt(2.0 * squares * math.log(math.e + math.sqrt(squares) / slack))
    return min(linear, first, second)


def selection_threshold(epsilon: float, delta: float, partitions: int = 1) -> float:
    """Noisy id count from which a key found in private data may be released."""
    if not 0 < delta < 1:
        raise ValueError(f"delta must lie between 0 and 1, got {delta}")
    per_partition = -math.expm1(math.log1p(-delta) / partitions)
    return 1.0 - (partitions / epsilon) * math.log(2.0 * per_partition)


def release_chance(units: Column | str, epsilon: float, delta: float, partitions: int = 1) -> Column:
    """The largest probability with which a key of so many units may be released (Desfontaines, Voss, Gipson, Mandayam 2020).

    It is the solution of p(0) = 0, p(n + 1) = min(e^epsilon p(n) + delta, 1 - e^-epsilon (1 - p(n) - delta), 1): no
    mechanism that only sees the number of units releases any key more often. A unit in several partitions shares
    epsilon and delta among them.
    """
    if not 0 < delta < 1:
        raise ValueError(f"delta must lie between 0 and 1, got {delta}")
    if not epsilon > 0:
        raise ValueError(f"epsilon must be positive, got {epsilon}")
    e, d = epsilon / partitions, -math.expm1(math.log1p(-delta) / partitions)
    growth = math.expm1(e)
    # the first branch holds up to `turn` units, the second up to `sure`, where its chance reaches 1
    turn = 1 + math.floor(math.log((growth + 2 * d) / (d * (growth + 2))) / e)
    at_turn = min(math.expm1(turn * e) / growth * d, 1.0)
    sure = turn + math.floor(math.log1p(growth / d * (1 - at_turn)) / e)
    n = _col(units).cast("double")
    rising = F.expm1(n * F.lit(e)) * F.lit(d / growth)
    fade = F.exp((F.lit(float(turn)) - n) * F.lit(e))
    falling = F.lit(1 + d / growth) * (F.lit(1.0) - fade) + fade * F.lit(at_turn)
    chance = F.when(n <= turn, rising).when(n <= sure, falling).otherwise(F.lit(1.0))
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(chance, F.lit(1.0)))
