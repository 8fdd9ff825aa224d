"""Exact integer samplers on operating-system randomness, for whole columns of released values.

Rejection samplers of Canonne, Kamath and Steinke (2020). Results are whole numbers with exactly the
probabilities asked for, so no value can be recognised by its low-order floating-point bits (Mironov 2012); real
valued mechanisms run on a power-of-two grid 2^-40 below the noise scale.

Coins are thrown for arrays. A coin compares a random 64-bit word with its probability, of which a double with an
error bound is known; a word within the bound (about one in 2^44) is decided by fractions. What a round rejects goes
into the next one together, so a column costs a few dozen array operations whatever its length.
"""

from __future__ import annotations

import math
import os
import secrets
import sys
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship this module with the tasks, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _coin(p: Fraction) -> bool:
    return secrets.randbelow(p.denominator) < p.numerator


def _exp_coin(rate: Fraction) -> bool:
    """True with probability exp(-rate)."""
    while rate > 1:
        if not _exp_coin(Fraction(1)):
            return False
        rate -= 1
    k = 1
    while _coin(rate / k):
        k += 1
    return k % 2 == 1


def discrete_laplace(scale: Fraction) -> int:
    """P(k) proportional to exp(-|k| / scale)."""
    top, bottom = scale.numerator, scale.denominator
    while True:
        fine = secrets.randbelow(top)
        if not _exp_coin(Fraction(fine, top)):
            continue
        coarse = 0
        while _exp_coin(Fraction(1)):
            coarse += 1
        size = (fine + top * coarse) // bottom
        negative = secrets.randbits(1)
        if size or not negative:
            return -size if negative else size


def discrete_gaussian(sigma_sq: Fraction) -> int:
    """P(k) proportional to exp(-k^2 / (2 sigma_sq))."""
    width = math.isqrt(math.floor(sigma_sq)) + 1
    while True:
        k = discrete_laplace(Fraction(width))
        gap = abs(k) - sigma_sq / width
        if _exp_coin(gap * gap / (2 * sigma_sq)):
            return k


#: Relative error that is allowed to the double of a coin's probability; doubles are better by far.
SLOPPY = 2.0**-44
WORDS = 2.0**64
#: Integers of this size and their products with small counts fit into 64 bits.
NARROW = 1 << 53


def _words(count: int) -> np.ndarray:
    return np.frombuffer(os.urandom(8 * count), np.uint64)


def coins(chance: np.ndarray, exact, size: np.ndarray | float = 1.0) -> np.ndarray:
    """True with exactly the probability whose double is `chance`.

    `exact(i)` is that probability as a fraction. The double may be wrong by `SLOPPY` times `size`. Words below the
    doubtful interval are heads, words above it tails; one inside is decided anew, with the chance that makes the
    whole exact.
    """
    word, level = _words(len(chance)), chance * WORDS
    error = SLOPPY * np.maximum(size, 2.0**-8) * WORDS
    low, high = np.floor(np.maximum(level - error, 0.0)), np.ceil(level + error)
    low = np.minimum(low, WORDS - 4096.0).astype(np.uint64)
    top = high >= WORDS
    high = np.where(top, 0.0, high).astype(np.uint64)
    heads = word < low
    for i in np.flatnonzero(~heads & (top | (word < high))):
        start, stop = int(low[i]), 1 << 64 if top[i] else int(high[i])
        inside = (exact(int(i)) * (1 << 64) - start) / (stop - start)
        heads[i] = _coin(min(max(inside, Fraction(0)), Fraction(1)))
    return heads


def below(limit: np.ndarray) -> np.ndarray:
    """Uniform whole numbers from zero to below the limits, which lie between 1 and `NARROW`."""
    out = np.zeros(len(limit), np.int64)
    bits = np.frexp((limit - 1).astype(np.float64))[1]
    open_ = np.flatnonzero(bits > 0)
    shift = (64 - np.maximum(bits, 1)).astype(np.uint64)
    while len(open_):
        drawn = (_words(len(open_)) >> shift[open_]).astype(np.int64)
        good = drawn < limit[open_]
        out[open_[good]] = drawn[good]
        open_ = open_[~good]
    return out


def exp_coins(rate: np.ndarray, exact, size: np.ndarray | float = 1.0) -> np.ndarray:
    """True with probability exp(-rate), for rates from zero to one; `exact(i)` is the rate as a fraction."""
    order = np.ones(len(rate), np.int64)
    open_ = np.arange(len(rate))
    size = np.broadcast_to(np.asarray(size, np.float64), rate.shape)
    while len(open_):
        k = order[open_]
        heads = coins(rate[open_] / k, lambda i: exact(int(open_[i])) / int(k[i]), size[open_])
        open_ = open_[heads]
        order[open_] += 1
    return order % 2 == 1


def _unit_exp_coins(count: int) -> np.ndarray:
    return exp_coins(np.ones(count), lambda i: Fraction(1))


def discrete_laplaces(scale: np.ndarray) -> np.ndarray:
    """P(k) proportional to exp(-|k| / scale) for each scale.

    Each double is a fraction top / bottom; scales whose fractions need more than 53 and 62 bits go one by one, and then
    the integers are Python's.
    """
    tops, bottoms = np.ones(len(scale), np.int64), np.ones(len(scale), np.int64)
    out = np.zeros(len(scale), np.int64)
    narrow = np.ones(len(scale), bool)
    values, places = np.unique(scale, return_inverse=True)
    for i, value in enumerate(values.tolist()):
        top, bottom = Fraction(value).as_integer_ratio()
        if top >= NARROW or bottom > 1 << 62:
            narrow[places == i] = False
        else:
            tops[places == i], bottoms[places == i] = top, bottom
    open_ = np.flatnonzero(narrow)
    while len(open_):
        top, bottom = tops[open_], bottoms[open_]
        fine = below(top)
        stay = exp_coins(fine / top, lambda i: Fraction(int(fine[i]), int(top[i])))
        coarse = np.zeros(len(open_), np.int64)
        going = np.flatnonzero(stay)
        while len(going):
            going = going[_unit_exp_coins(len(going))]
            coarse[going] += 1
        size = (fine + top * coarse) // bottom
        negative = _words(len(open_)) >> np.uint64(63) == 1
        stay &= (size > 0) | ~negative
        out[open_[stay]] = np.where(negative, -size, size)[stay]
        open_ = open_[~stay]
    return out if narrow.all() else _one_by_one(out, ~narrow, discrete_laplace, scale)


def _one_by_one(out: np.ndarray, wide: np.ndarray, sampler, scale) -> np.ndarray:
    """The column with the wide places drawn singly, as integers of any size."""
    whole = out.astype(object)
    for i in np.flatnonzero(wide):
        whole[i] = sampler(Fraction(scale[i]))
    return whole


def discrete_gaussians(sigma_sq: np.ndarray | list[Fraction]) -> np.ndarray:
    """P(k) proportional to exp(-k^2 / (2 sigma_sq)) for each variance (doubles, or fractions)."""
    kinds: dict[Fraction, int] = {}
    of = np.array([kinds.setdefault(Fraction(v), len(kinds)) for v in sigma_sq], np.int64)
    exact = list(kinds)
    wide = np.array([v >= NARROW**2 // 4 for v in exact], bool)
    widths = np.array([1 if w else math.isqrt(math.floor(v)) + 1 for v, w in zip(exact, wide)], np.int64)
    doubles = np.array([float(v) for v in exact])
    out = np.zeros(len(of), np.int64)
    open_ = np.flatnonzero(~wide[of])
    while len(open_):
        kind = of[open_]
        k = discrete_laplaces(widths[kind].astype(np.float64))

        def rate(i: int) -> Fraction:
            v = exact[kind[i]]
            gap = abs(int(k[i])) - v / int(widths[kind[i]])
            return gap * gap / (2 * v)

        centre = doubles[kind] / widths[kind]
        gap = np.abs(np.abs(k) - centre)
        double = gap * gap / (2 * doubles[kind])
        # |k| and the centre are known to a few units of the last place, so the rate is to that of their larger square
        size = np.maximum(1.0, (np.abs(k) + centre) ** 2 / (2 * doubles[kind]))
        whole = np.floor(double)
        for i in np.flatnonzero(np.abs(double - np.rint(double)) <= size * 2.0**-40):
            whole[i] = math.floor(rate(int(i)))
            double[i] = float(rate(int(i)))
        stay = np.ones(len(open_), bool)
        left = whole.copy()
        going = np.flatnonzero(left > 0)
        while len(going):
            heads = _unit_exp_coins(len(going))
            stay[going[~heads]] = False
            left[going] -= 1
            going = going[heads & (left[going] > 0)]
        going = np.flatnonzero(stay)
        part = np.clip(double[going] - whole[going], 0.0, 1.0)
        stay[going] = exp_coins(part, lambda i: rate(int(going[i])) - int(whole[going[i]]), size[going])
        out[open_[stay]] = k[stay]
        open_ = open_[~stay]
    return _one_by_one(out, wide[of], discrete_gaussian, sigma_sq) if wide[of].any() else out


def noisy_values(mechanism: str, values, scales, grid: float | None = None) -> list:
    """A column of exact values plus noise; scales are variances for the Gaussian mechanisms."""
    scales = np.asarray(scales, np.float64)
    if mechanism in ("geometric", "discrete_gaussian"):
        noise = discrete_laplaces(scales) if mechanism == "geometric" else discrete_gaussians(scales)
        noisy = [int(v) + k for v, k in zip(values, noise.tolist())]
        return [n * grid for n in noisy] if grid else noisy
    spread = scales if mechanism == "laplace" else np.sqrt(scales)
    step = np.exp2(np.ceil(np.log2(spread)) - 40)
    if mechanism == "laplace":
        noise = discrete_laplaces(spread / step)
    else:
        noise = discrete_gaussians([Fraction(s) ** 2 for s in (spread / step).tolist()])
    return [_on_grid(float(v), s, k) for v, s, k in zip(values, step.tolist(), noise.tolist())]


def _on_grid(value: float, step: float, noise: int) -> float:
    steps = value / step
    if math.isfinite(steps):
        return (round(steps) + noise) * step
    return float((round(Fraction(value) / Fraction(step)) + noise) * Fraction(step))


def noisy_value(mechanism: str, value: float, scale: float, grid: float | None = None):
    """One exact value plus noise; ``scale`` is a variance for the Gaussian mechanisms."""
    if mechanism == "geometric":
        noisy = int(value) + discrete_laplace(Fraction(scale))
        return noisy * grid if grid else noisy
    if mechanism == "discrete_gaussian":
        noisy = int(value) + discrete_gaussian(Fraction(scale))
        return noisy * grid if grid else noisy
    spread = scale if mechanism == "laplace" else math.sqrt(scale)
    step = 2.0 ** (math.ceil(math.log2(spread)) - 40)
    if mechanism == "laplace":
        steps = discrete_laplace(Fraction(spread / step))
    else:
        steps = discrete_gaussian(Fraction(spread / step) ** 2)
    return (round(value / step) + steps) * step


def os_coin(chance: Column) -> Column:
    """True with exactly the probability that the double says, thrown anew for each row."""
    def throw(rows: pd.Series) -> pd.Series:
        given = np.clip(rows.to_numpy(np.float64), 0.0, 1.0)
        return pd.Series(coins(given, lambda i: Fraction(given[i])))

    return F.pandas_udf(throw, "boolean").asNondeterministic()(chance)


def os_uniform(per_row: Column) -> Column:
    """A fresh double strictly between 0 and 1 for each row."""
    def draw(rows: pd.Series) -> pd.Series:
        bits = np.frombuffer(os.urandom(8 * len(rows)), dtype=np.uint64) >> np.uint64(12)
        return pd.Series((bits + 0.5) / 2.0**52)

    return F.pandas_udf(draw, "double").asNondeterministic()(per_row)
