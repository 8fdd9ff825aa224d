"""Tight composition: the distribution of the privacy loss, composed on a grid by its Fourier transform.

A spend is one of three kinds, each of which has the worst distribution of its loss in closed form: ``gaussian``
(mechanism ``gaussian`` with a rho: a normal loss), ``laplace`` (mechanism ``laplace`` with an epsilon and no delta, one
released number: two atoms and a density between them) and ``pure`` (any other epsilon: randomised response). Every
approximation errs upwards: sizes are rounded up to ten significant bits, a loss between two grid points is split over
both so that its mean likelihood ratio stays (hockey-stick divergences are convex in the ratio, so none falls), masses
beyond the upper end and the error bound of the transforms count as infinite losses.

The spends of a session of up to ``DIRECT``, none of them Gaussian, are added up on the grid one by one in two
halves, and tails of the sum of the halves are looked up until epsilon is found: no transform. For other sessions the
transform of a sum is the product of the transforms, which are known in closed form; the Gaussian spends of a session
are one normal loss, and without one, spends added up one by one stand first. Where the product of the spends so far is
too small to matter, the others are not computed, so a session costs one transform back and, per class of spends, the
few frequencies that are left.

One row per session, kind and rounded size reaches a task, whatever the number of spends; rounding bounds the number
of sizes by some ten thousand per session.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.operators.matching import null_safe_join
from hushframe.plans.ledger import advanced_totals

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Grid points per standard deviation of the total loss.
FINE = 4096
#: Significant bits of a size.
BITS = 10
#: Part of the slack that one cut at either end of a distribution may take.
CUT = 1e-9
#: A larger size, or a larger total loss, counts as infinite: its likelihood ratio is beyond a double.
LARGE = 24.0
FAR = 700.0
EPS = 2.0**-52
#: Up to DIRECT spends of a session are added up one by one; of more spends only FIRST, of a class no more than FEW.
DIRECT = 512
FIRST = 128
FEW = 16
#: Running sums are taken within blocks of so many, over the blocks of a group and over groups: their rounding stays small.
BLOCK = 16
UPTO = np.triu(np.ones((BLOCK, BLOCK)))
#: Points and weights of numerical integration.
NODES = np.polynomial.legendre.leggauss(16)


class Losses:
    """Masses of losses ``(low + i) * step``, and the mass of the infinite loss."""

    def __init__(self, low: int, mass: np.ndarray, lost: float):
        self.low, self.mass, self.lost = low, mass, lost

    def epsilon(self, slack: float, step: float) -> float:
        """The least epsilon >= 0 whose delta is at most the slack; infinite if there is none."""
        start = min(max(1 - self.low, 0), len(self.mass))
        stop = min(max(math.floor(FAR / step) - self.low + 1, start), len(self.mass))
        lost, aim = self.lost + float(self.mass[stop:].sum()), slack * (1 - 2e-9)
        if lost > aim:
            return math.inf
        loss, mass = (self.low + np.arange(start, stop)) * step, self.mass[start:stop]
        above = np.append(np.cumsum(mass[::-1])[::-1], 0.0)
        tilted = np.append(np.cumsum((mass * np.exp(-loss))[::-1])[::-1], 0.0)
        points = np.append(0.0, loss)
        # delta at each point counts the losses from there on; a loss equal to the point adds nothing
        delta = lost + above - np.exp(points) * tilted
        first = int(np.argmax(delta <= aim))
        if first == 0:
            return 0.0
        # between two points delta is lost + above - e^epsilon tilted, of the losses from the upper one on
        wanted = lost + above[first - 1] - aim
        found = float(min(max(math.log(wanted / tilted[first - 1]), points[first - 1]), points[first]))
        # the running sums are rounded: raise the result until the sum over all losses says that it is enough
        raise_by = 1e-12 * step
        loss, mass = loss[first - 1 :], mass[first - 1 :]
        while lost + float((mass * -np.expm1(np.minimum(found - loss, 0.0))).sum()) > slack * (1 - 1e-9):
            found, raise_by = found + raise_by, 4 * raise_by
            if found >= FAR:
                return math.inf
        return found


class Halves:
    """The sum of two independent losses made by ``Spends.added``, of which only tails are computed.

    Masses ``m`` of such losses mirror each other: ``m(-x) = e^(-x) m(x)``, so read backwards they are likelihoods.
    """

    def __init__(self, one: Losses, two: Losses, step: float):
        one, two = sorted((one, two), key=lambda part: len(part.mass))
        self.step, self.lost = step, one.lost + two.lost
        self.top, self.ahead = -one.low - two.low, one.low - two.low
        #: From the largest loss of one down, and from the smallest loss of two on, for masses and for likelihoods.
        self.parts = [
            (one.mass[::-1].copy(), np.cumsum(two.mass[::-1])[::-1].copy()),
            (one.mass, np.cumsum(two.mass)[::-1].copy()),
        ]
        self.rounding = 2 * (len(one.mass) + len(two.mass) + 64) * EPS

    def tails(self, point: int) -> tuple[float, float]:
        """The mass of the losses from a grid point >= 0 on, not below it, and their likelihood, not above it."""
        found = []
        for down, tails in self.parts:
            # a loss of one needs at least what it lacks to the point from two
            needed = tails[point + self.ahead :][: len(down)]
            found.append(float(down[: len(needed)] @ needed))
        return found[0] * (1 + self.rounding), found[1] * (1 - self.rounding)

    def epsilon(self, slack: float) -> float:
        """The least epsilon >= 0 whose delta is at most the slack; infinite if there is none."""
        aim, step = slack * (1 - 2e-9), self.step
        if self.lost > aim:
            return math.inf
        # delta is at most aim at the point high, but not below low; Newton's steps in its logarithm, or halving
        low, high, point, steps = 0, self.top + 1, 0, 0
        while low < high:
            above, tilted = self.tails(point)
            slope = math.exp(point * step) * tilted
            delta = self.lost + above - slope
            low, high = (low, point) if delta <= aim else (point + 1, high)
            more = math.log(delta / aim) * delta / (slope * step) if min(delta, slope) > 0 else math.inf
            steps += 1
            near = abs(more) < (high - low) / 2 and steps < 20
            point = min(max(math.floor(point + more), low), high - 1) if near else (low + high) // 2
        if high == 0:
            return 0.0
        # between two points delta is lost + above - e^epsilon tilted, of the losses from the upper one on
        above, tilted = self.tails(high)
        wanted = self.lost + above - aim
        if wanted <= 0 or tilted <= 0:
            return (high - (wanted <= 0)) * step
        return min(max(math.log(wanted) - math.log(tilted), (high - 1) * step), high * step)


def _angle(steps: np.ndarray, wide: int) -> np.ndarray:
    """The angle of ``steps`` parts of a circle of ``wide`` (a power of two), without whole turns."""
    return (steps & (wide - 1)) * (2 * np.pi / wide)


def _turn(steps: np.ndarray, wide: int) -> np.ndarray:
    return np.exp(-1j * _angle(steps, wide))


def _turn_less_one(growth: np.ndarray | float, steps: np.ndarray, wide: int) -> np.ndarray:
    """``e^growth`` times the turn, less one, without cancellation."""
    angle = _angle(steps, wide)
    turn = np.exp(-1j * angle)
    return turn * np.expm1(growth) + (1j * turn.imag - 2 * np.sin(angle / 2) ** 2)


class Spends:
    """Losses on the grid of spends of the kinds ``pure`` and ``laplace``, one row per spend.

    Masses at four points, those of two atoms and of the parts of the density in the cells of the atoms; the whole
    cells between them hold masses that grow from cell to cell by the factor ``e^(step / 2)``.
    """

    def __init__(self, kinds: list[str], sizes: list[float], step: float):
        size, half = np.array(sizes), np.array([0.5 if kind == "laplace" else 0.0 for kind in kinds])
        self.step, self.half, self.cells = step, half, np.floor(size / step).astype(np.int64)
        top, bottom = self.cells, -np.ceil(size / step).astype(np.int64)
        edge = np.where(-bottom > top, np.maximum(size - top * step, 0.0), 0.0)
        whole, push = -math.expm1(-step), 8 * EPS * (1 + size / step)
        self.size, self.push = size, push
        self.points = np.stack([bottom, bottom + 1, top, top + 1], axis=1)
        up = np.where(half > 0, 0.5, 1.0 / (1.0 + np.exp(-size)))
        down = np.where(half > 0, 0.5 * np.exp(-size), 1.0 / (1.0 + np.exp(size)))
        self.masses = np.zeros((len(size), 4))
        for at, atom, p, q in (
            (0, down, half * np.exp(-size) * np.expm1(edge / 2), -half * np.expm1(-edge / 2)),
            (2, up, -half * np.expm1(-edge / 2), half * np.exp(-size) * np.expm1(edge / 2)),
        ):
            start, loss = self.points[:, at] * step, size if at else -size
            share = np.minimum(-np.expm1(-np.maximum(loss - start, 0.0)) / whole + push, 1.0)
            part = np.clip((p - q * np.exp(start)) / whole + p * push / step, 0.0, p)
            self.masses[:, at] = atom * (1 - share) + p - part
            self.masses[:, at + 1] = atom * share + part
        #: The mass of the lowest whole cell, and the share of each cell's mass at its upper end.
        self.lowest = half * np.exp(-(size + top * step) / 2) * math.expm1(step / 2)
        self.upper = min(1.0, (1 + 8 * EPS) / (1 + math.exp(-step / 2)))

    def losses(self, row: int) -> Losses:
        """The masses of one spend."""
        low = int(self.points[row, 0])
        mass = np.zeros(int(self.points[row, 3]) - low + 1)
        np.add.at(mass, self.points[row] - low, self.masses[row])
        cells = int(self.cells[row])
        if cells and self.half[row]:
            inside = self.lowest[row] * np.exp(np.arange(2 * cells) * (self.step / 2))
            mass[-cells - low : cells - low] += inside * (1 - self.upper)
            mass[-cells - low + 1 : cells - low + 1] += inside * self.upper
        return Losses(low, mass, 0.0)

    def added(self, rows: np.ndarray) -> Losses:
        """The sum of the losses of the rows, added up one by one; rows may come twice, their sizes add up to ``FAR`` at most.

        Times ``e^(-loss / 2)``, the masses of a spend are the same at a loss and its negative, and those of the whole
        cells are equal. So the masses of a sum are kept for losses from the largest down to zero only; a spend costs
        four shifts of them and, for the cells, one difference of running sums. These begin at the largest loss, where
        masses are small, so their rounding stays small beside each mass.
        """
        rows, step = rows[np.argsort(self.size[rows], kind="stable")], self.step
        near = np.exp(-self.cells * (step / 2))
        inside = self.half * np.exp(-self.size / 2) * (2 * math.expm1(step / 2) * math.exp(-step / 2) * self.upper)
        inside[self.cells == 0] = 0.0
        # the ends of the cells count half, with the atoms
        atom, past = self.masses[:, 2] * near - inside / 2, self.masses[:, 3] * near * math.exp(-step / 2)
        # what was pushed up at the upper end falls by a cell in the mirror
        rounding = 16 * EPS + 2 * self.push * step
        columns = (self.cells, atom, past, inside, rounding)
        masses, top, lost = np.ones(1), 0, 0.0
        for cells, atom, past, inside, error in zip(*[column[rows].tolist() for column in columns]):
            # the losses from top down to zero, and their mirror down to -cells - 1
            size, both = top + cells + 2, max(top - cells + 1, 0)
            mirror = masses[max(top - cells - 1, 0) : top][::-1]
            zeros = np.zeros(-(-size // BLOCK**2) * BLOCK**2 - top - 1 - len(mirror))
            given = np.concatenate([masses, mirror, zeros])
            masses = np.correlate(given[:size], [atom, past], "full")[:size]
            if both:
                masses[-both:] += np.correlate(given[:both], [past, atom], "full")[:both]
            if inside:
                blocks = given.reshape(-1, BLOCK) @ (UPTO * inside)
                groups = blocks[:, -1].reshape(-1, BLOCK) @ UPTO
                groups[1:] += groups[:-1, -1].cumsum()[:, None]
                blocks[1:] += groups.reshape(-1)[:-1, None]
                sums = blocks.reshape(-1)
                masses[1:] += sums[: size - 1]
                if both > 1:
                    masses[1 - both :] -= sums[: both - 1]
                lost += (2 * BLOCK + len(groups) + 4) * EPS
            top, lost = top + cells + 1, lost + error
        masses, growth = np.maximum(masses, 0.0), np.exp(np.arange(top, -1, -1) * (step / 2))
        lost += (8 + top * step) * EPS
        return Losses(-top, np.concatenate([masses / growth, (masses * growth)[-2::-1]]), lost)

    def transforms(self, at: np.ndarray, wide: int) -> np.ndarray:
        """The transforms at the frequencies ``at`` of ``wide``, one row per spend."""
        found = np.zeros((len(self.half), len(at)), complex)
        for points, masses in zip(self.points.T, self.masses.T):
            found += masses[:, None] * _turn(np.outer(points, at), wide)
        dense = np.flatnonzero((self.half > 0) & (self.cells > 0))
        if len(dense):
            cells = self.cells[dense]
            above = _turn_less_one(cells[:, None] * self.step, np.outer(2 * cells, at), wide)
            below = _turn_less_one(self.step / 2, at, wide)
            start = self.lowest[dense][:, None] * _turn(np.outer(-cells, at), wide)
            found[dense] += start * (1 - self.upper + self.upper * _turn(at, wide)) * (above / below)
        return found


def gaussian_losses(mu: float, step: float) -> Losses:
    """Gaussian noise with sensitivity ``mu`` standard deviations; beyond nine deviations a loss is infinite."""
    middle = mu * mu / 2
    low, high = math.floor((middle - 9 * mu) / step), math.ceil((middle + 9 * mu) / step)
    edges = np.arange(low, high + 1) * step

    def inside(centre: float) -> np.ndarray:
        z = (edges - centre) / (mu * math.sqrt(2.0))
        left = np.array([0.5 * math.erfc(-x) for x in z.tolist()])
        right = np.array([0.5 * math.erfc(x) for x in z.tolist()])
        return np.where(z[1:] <= 0, np.diff(left), -np.diff(right))

    start, p, q = edges[:-1], inside(middle), inside(-middle)
    share = (p - q * np.exp(start)) / -math.expm1(-step)
    share = np.clip(share + 16 * EPS * p / step, 0.0, p)
    mass = np.zeros(len(p) + 1)
    mass[:-1] += p - share
    mass[1:] += share
    mass[0] += 1e-18
    return Losses(low, mass, 1e-18 + max(0.0, 1.0 - float(mass.sum())))


def gaussian_transform(mu: float, step: float, at: np.ndarray, wide: int) -> np.ndarray:
    """The transform of Gaussian noise on the grid, for frequencies so low that no other period matters.

    A loss in the part u of its cell is split over the ends of the cell: the transform of the normal loss, times the
    mean over u of what the split does.
    """
    angle = at * (2 * np.pi / wide)
    nodes, weights = NODES
    u = (nodes + 1) / 2
    share = np.expm1(-step * u) / math.expm1(-step)
    split = (1 - share) * np.exp(1j * np.outer(angle, u)) + share * np.exp(1j * np.outer(angle, u - 1))
    deviation = mu / step
    return np.exp(-((angle * deviation) ** 2) / 2 - 1j * angle * (deviation * mu / 2)) * (split @ (weights / 2))


class Product:
    """A product of transforms at those frequencies where it may exceed ``tiny``, and a bound of its error.

    Each factor may be wrong by ``error``. A product of values raised by the errors bounds both the product, which
    tells what can be left out, and, less the product itself, the error.
    """

    def __init__(self, wide: int, tiny: float):
        self.wide, self.tiny, self.error = wide, tiny, 8 * EPS * math.log2(wide)
        self.at = np.arange(wide // 2 + 1)
        self.value = np.ones(len(self.at), complex)
        self.size, self.raised = np.zeros(len(self.at)), np.zeros(len(self.at))

    def only(self, kept: np.ndarray | slice) -> None:
        self.at, self.value = self.at[kept], self.value[kept]
        self.size, self.raised = self.size[kept], self.raised[kept]

    def multiply(self, factors: np.ndarray, counts: np.ndarray) -> None:
        """By rows of factors, each ``counts`` times."""
        counts = counts.astype(float)[:, None]
        size = np.maximum(np.abs(factors), self.error)
        self.value = self.value * (factors if (counts == 1).all() else np.power(factors, counts)).prod(axis=0)
        self.size = self.size + (counts * np.log(size)).sum(axis=0)
        self.raised = self.raised + (counts * np.log1p(self.error / size)).sum(axis=0)
        kept = self.size + self.raised > math.log(self.tiny)
        if kept.sum() < 0.9 * len(kept):
            self.only(kept)

    def masses(self, low: int) -> tuple[np.ndarray, float]:
        """The masses from the grid point ``low`` on, and a bound of the sum of their errors."""
        spectrum = np.zeros(self.wide // 2 + 1, complex)
        spectrum[self.at] = self.value * _turn(-self.at * low, self.wide)
        error = np.exp(self.size) * np.expm1(np.minimum(self.raised, 1.0))
        error = np.where(self.raised < 1.0, error, np.exp(self.size + self.raised))
        # the sum of errors of masses is at most the root of the sum of squared errors of the transform
        bound = math.sqrt(2 * float((error * error).sum())) + self.tiny * math.sqrt(self.wide)
        bound += self.error * math.sqrt(2 * float((np.abs(self.value) ** 2).sum()))
        return np.maximum(np.fft.irfft(spectrum, self.wide), 0.0), bound


def composed(mu: float, rest: list[tuple[str, float, int]], step: float, cut: float) -> Losses:
    """The sum of a Gaussian loss (none if ``mu`` is 0) and the losses of the other spends.

    All losses but the Gaussian one are bounded, so the total less its mean is sub-Gaussian (Hoeffding): the grid
    spans all but the mass ``cut`` at either end. What lies below comes out at the upper end, as a larger loss.
    """
    counts = np.array([count for *_, count in rest], np.int64)
    spread = mu * mu + math.fsum(n * ((math.floor(x / step) + 1) * step) ** 2 for _, x, n in rest)
    mean = mu * mu / 2
    mean += math.fsum(n * (x + math.expm1(-x) if k == "laplace" else x * math.tanh(x / 2)) for k, x, n in rest)
    reach = math.sqrt(2 * spread * -math.log(cut))
    if mean - reach - step > FAR:
        return Losses(0, np.zeros(1), 1.0)
    # splitting a loss over two grid points raises its mean by no more than this many of them
    shift = (1 + float(counts.sum())) * min(1.0, step / 8 + 1e-9)
    low, high = math.floor((mean - reach) / step) - 2, math.ceil((mean + reach) / step + shift) + 2
    wide = 1 << (high - low).bit_length()
    tiny = cut / math.sqrt(wide)
    product, lost = Product(wide, tiny), cut
    deviations = math.sqrt(2 * math.log(2 / tiny))
    if mu / step > deviations * 2 / math.pi:
        # beyond, below a quarter of the frequencies, the transform of the normal loss is less than tiny
        product.only(slice(0, math.floor(deviations * step / mu * wide / (2 * math.pi)) + 2))
        product.multiply(gaussian_transform(mu, step, product.at, wide)[None, :], np.ones(1))
    elif mu > 0:
        part = gaussian_losses(mu, step)
        lost += part.lost
        product.multiply(_by_fft(part, product.at, wide)[None, :], np.ones(1))
    rest = sorted(rest, key=lambda spend: -spend[1] * spend[1] * spend[2])
    if len(product.at) > wide // 16:
        few, rest = _few(rest)
        if few:
            part = Spends([kind for kind, *_ in few], [size for _, size, _ in few], step)
            part = part.added(np.repeat(np.arange(len(few)), [count for *_, count in few]))
            lost += part.lost
            product.multiply(_by_fft(part, product.at, wide)[None, :], np.ones(1))
    counts = np.array([count for *_, count in rest], np.int64)
    done = 0
    while done < len(rest) and len(product.at):
        some = rest[done : done + max(1, (1 << 16) // len(product.at))]
        part = Spends([kind for kind, *_ in some], [size for _, size, _ in some], step)
        if len(product.at) > wide // 16:
            factors = _by_fft(part.losses(0), product.at, wide)[None, :]
        else:
            factors = part.transforms(product.at, wide)
        product.multiply(factors, counts[done : done + len(factors)])
        done += len(factors)
    mass, error = product.masses(low)
    return Losses(low, mass, lost + error)


def _few(spends: list[tuple[str, float, int]]) -> tuple[list, list]:
    """The first spends of classes of up to ``FEW``, which are added up one by one, and all others."""
    some, others, number, total = [], [], 0, 0.0
    for spend in spends:
        _, size, count = spend
        if count <= FEW and number + count <= FIRST and total + size * count <= FAR:
            some.append(spend)
            number, total = number + count, total + size * count
        else:
            others.append(spend)
    return some, others


def _by_fft(losses: Losses, at: np.ndarray, wide: int) -> np.ndarray:
    """The transform of masses at many frequencies."""
    places = (losses.low + np.arange(len(losses.mass))) & (wide - 1)
    found = np.fft.rfft(np.bincount(places, losses.mass, wide))
    return found if len(at) == len(found) else found[at]


def tight_epsilon(spends: list[tuple[str, float, int]], slack: float) -> float:
    """The epsilon of spends (kind, size, how many) at a delta of ``slack``; sizes are epsilons, or ``sqrt(2 rho)``."""
    spends = [(kind, size, int(count)) for kind, size, count in spends if size > 0]
    if not spends:
        return 0.0
    if max(size for _, size, _ in spends) > LARGE:
        return math.inf
    step = math.sqrt(math.fsum(size * size * count for _, size, count in spends)) / FINE
    rest = [spend for spend in spends if spend[0] != "gaussian"]
    mu = math.sqrt(math.fsum(size * size * count for kind, size, count in spends if kind == "gaussian")) * (1 + 4 * EPS)
    if not mu and len(rest) == 1 and rest[0][2] == 1:
        return Spends([rest[0][0]], [rest[0][1]], step).losses(0).epsilon(slack, step)
    if not mu and sum(count for *_, count in rest) <= DIRECT and math.fsum((x + step) * n for _, x, n in rest) <= FAR:
        rest = sorted(rest, key=lambda spend: spend[1])
        part = Spends([kind for kind, *_ in rest], [size for _, size, _ in rest], step)
        rows = np.repeat(np.arange(len(rest)), [count for *_, count in rest])
        return Halves(part.added(rows[::2]), part.added(rows[1::2]), step).epsilon(slack)
    return composed(mu, rest, step, slack * CUT).epsilon(slack, step)


def _rounded_up(size: Column) -> Column:
    """The size with ten significant bits, not below it; zero and infinity stay."""
    place = F.pow(F.lit(2.0), F.floor(F.log2(size)).cast("double") - F.lit(float(BITS - 1)))
    finite = (size > 0) & (size < F.lit(math.inf))
    return F.when(finite, F.ceil(size / place).cast("double") * place).otherwise(size)


def compose_losses(spends: DataFrame, slack: float) -> DataFrame:
    """session and epsilon: of all its spends, at a delta of ``slack`` beside the spends' own deltas.

    A spend without an epsilon must be of the mechanism ``gaussian`` with a rho, otherwise it is refused. A NULL
    session is a session. Without spends no row.
    """
    if not 0 < slack < 1:
        raise ValueError(f"slack must lie in (0, 1), got {slack}")
    mechanism, epsilon, rho = F.col("mechanism"), F.col("epsilon").cast("double"), F.col("rho").cast("double")
    no_delta = F.coalesce("delta", F.lit(0.0)) == 0
    normal = F.coalesce(mechanism == "gaussian", F.lit(False)) & rho.isNotNull()
    kind = (
        F.when(normal, "gaussian")
        .when(F.coalesce(mechanism == "laplace", F.lit(False)) & epsilon.isNotNull() & no_delta, "laplace")
        .when(epsilon.isNotNull(), "pure")
        .otherwise(F.raise_error(F.lit("a spend that has neither an epsilon nor a Gaussian rho")).cast("string"))
    )
    size = F.when(normal, F.sqrt(F.lit(2.0) * rho)).otherwise(epsilon)
    size = F.when(size < 0, F.raise_error(F.lit("a spend below zero")).cast("double")).otherwise(size)
    classes = spends.groupBy("session", kind.alias("kind"), _rounded_up(size).alias("size")).agg(
        F.count(F.lit(1)).alias("n")
    )

    # few bytes make much work here: with a number given, small partitions are not put together
    parts = int(spends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("session").orderBy("kind", "size")
    ordered = classes.repartition(parts, "session").withColumn("_rank", F.row_number().over(order))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sessions, given = [], []
        for batch in batches:
            ranks, rows = batch["_rank"].to_numpy(), list(zip(*[batch[c].to_pylist() for c in ("kind", "size", "n")]))
            starts = np.flatnonzero(ranks == 1)
            cuts = [0, *starts.tolist(), len(rows)]
            # a session may begin in one batch and end in another
            given += rows[: cuts[1]]
            found = []
            for start, end in zip(cuts[1:], cuts[2:]):
                if given:
                    found.append(tight_epsilon(given, slack))
                given = rows[start:end]
            sessions += batch["session"].take(pa.array(starts)).to_pylist()
            if found:
                yield _totals(sessions[: len(found)], found, batch.schema.field("session").type)
                sessions = sessions[len(found) :]
        if given:
            yield _totals(sessions, [tight_epsilon(given, slack)], batch.schema.field("session").type)

    session = spends.schema["session"].dataType.simpleString()
    return ordered.mapInArrow(compose, f"session {session}, epsilon double")


def _totals(sessions: list, epsilons: list[float], kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch({"session": pa.array(sessions, kind), "epsilon": pa.array(epsilons, pa.float64())})


def compose_tight(spends: DataFrame, slack: float) -> DataFrame:
    """Total epsilon and delta per session, and the number of spends, when ``slack`` of delta is given up.

    The smaller of the composed losses and, where every spend has an epsilon, the closed forms of
    ``compose_advanced``; the delta is the same in both.
    """
    tight = compose_losses(spends, slack).withColumnRenamed("epsilon", "_tight")
    closed = advanced_totals(spends, slack, F.col("epsilon"))
    whole = F.when(F.col("_given") == F.col("spends"), F.col("epsilon"))
    both = null_safe_join(closed, tight, ["session"])
    return both.select("session", F.least("_tight", whole).alias("epsilon"), "delta", "spends")
