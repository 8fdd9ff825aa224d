"""Noise as Column expressions over uniforms, and the two noise sources.

``SeededNoise`` is for tests and error studies: whoever knows the seed can remove the noise.
``SecureNoise`` draws from the operating system inside the tasks and writes each release once.
Both touch one row per released key, never the private rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions import secure
from hushframe.functions.uniform import uniform
from hushframe.plans.materialise import materialise

MECHANISMS = ("laplace", "geometric", "gaussian", "discrete_gaussian")


def laplace(u: Column, scale: Column) -> Column:
    """Laplace noise with the given scale from one uniform."""
    centred = u - F.lit(0.5)
    return -scale * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def two_sided_geometric(u1: Column, u2: Column, scale: Column) -> Column:
    """Integer noise with P(k) proportional to exp(-|k| / scale), from two uniforms."""
    def one_sided(u: Column) -> Column:
        return F.floor(F.log(u) / (F.lit(-1.0) / scale))

    return one_sided(u1) - one_sided(u2)


def gaussian(u1: Column, u2: Column, sigma_sq: Column) -> Column:
    """Normal noise with the given variance from two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(u1))
    return F.sqrt(sigma_sq) * radius * F.cos(F.lit(2.0 * math.pi) * u2)


#: Tries of a rejection sampler. Each succeeds with a probability of 0.4 at least.
TRIES = 256


def discrete_gaussian(u: Callable[[Column], Column], sigma_sq: Column) -> Column:
    """Integer noise with P(k) proportional to exp(-k^2 / (2 sigma_sq)), by rejection from geometric noise.

    ``u`` gives the uniform of a stream number; try ``a`` takes the streams 3a + 1 to 3a + 3. Two tries do on
    average, for any sigma, and tries after the first success are not evaluated. A row all of whose
    tries fail, for which the probability is below 1e-50, raises.
    """
    width = F.floor(F.sqrt(sigma_sq)).cast("double") + F.lit(1.0)

    def attempt(a: Column) -> Column:
        stream = a * F.lit(3)
        k = two_sided_geometric(u(stream + F.lit(1)), u(stream + F.lit(2)), width)
        gap = F.abs(k).cast("double") - sigma_sq / width
        return F.when(u(stream + F.lit(3)) < F.exp(-(gap * gap) / (F.lit(2.0) * sigma_sq)), k)

    tries = F.sequence(F.lit(0), F.lit(TRIES - 1))
    found = F.aggregate(
        tries, F.lit(None).cast("bigint"), lambda acc, a: F.when(acc.isNotNull(), acc).otherwise(attempt(a))
    )
    return F.coalesce(found, F.raise_error(F.lit("every try of a sampler failed")).cast("bigint"))


@dataclass(frozen=True)
class Draw:
    """Noise wanted on one exact column of an aggregated table.

    ``scale`` is a number or a column name: the Laplace or geometric scale, or the variance of
    the two Gaussian mechanisms. ``grid`` (> 0) says that the exact column counts whole grid
    steps, so that the noisy value is multiplied by it.
    """

    column: str
    mechanism: str
    scale: float | str
    grid: float | None = None

    def __post_init__(self) -> None:
        if self.mechanism not in MECHANISMS:
            raise ValueError(f"unknown mechanism: {self.mechanism}")
        if not isinstance(self.scale, str) and not self.scale > 0:
            raise ValueError(f"noise scale must be positive, got {self.scale}")

    def scale_column(self) -> Column:
        return F.col(self.scale) if isinstance(self.scale, str) else F.lit(float(self.scale))

    @property
    def whole(self) -> bool:
        return self.mechanism in ("geometric", "discrete_gaussian")


@dataclass(frozen=True)
class SeededNoise:
    """Reproducible noise: each draw is keyed by the seed, the column, a stream number and the group."""

    unsafe_seed: str | int
    algorithm: str = "xxhash64"

    def add(
        self, df: DataFrame, draws: Sequence[Draw], keys: Sequence[str] = (), keep: Column | None = None
    ) -> DataFrame:
        """Replace each drawn column by its noisy value; only rows that satisfy ``keep`` are released."""
        noisy = {}
        for draw in draws:
            value = F.col(draw.column) + self.noise(
                draw.mechanism, draw.column, draw.scale_column(), keys
            )
            if draw.grid:
                value = value.cast("double") * F.lit(draw.grid)
            elif draw.whole:
                value = value.cast("bigint")
            noisy[draw.column] = value
        df = df.withColumns(noisy)
        return df if keep is None else df.filter(keep)

    def noise(self, mechanism: str, label: str, scale: Column, keys: Sequence[str | Column]) -> Column:
        """The noise alone, as a Column."""
        def u(stream: int | Column) -> Column:
            return self.uniform(label, keys, stream)

        if mechanism == "laplace":
            return laplace(u(1), scale)
        if mechanism == "geometric":
            return two_sided_geometric(u(1), u(2), scale)
        if mechanism == "gaussian":
            return gaussian(u(1), u(2), scale)
        return discrete_gaussian(u, scale)

    def uniform(self, label: str, keys: Sequence[str | Column], stream: int | Column = 1) -> Column:
        parts = (F.lit(label), F.lit(stream), *keys)
        return uniform(self.unsafe_seed, *parts, algorithm=self.algorithm)

    def coin(self, label: str, keys: Sequence[str | Column], chance: Column) -> Column:
        """True with the given probability."""
        return self.uniform(label, keys) < chance

    def settle(self, df: DataFrame) -> DataFrame:
        """Nothing to do: the same key gives the same noise in every action."""
        return df


@dataclass(frozen=True)
class SecureNoise:
    """Operating-system randomness, drawn once: the noisy table is written before it is read."""

    def add(
        self, df: DataFrame, draws: Sequence[Draw], keys: Sequence[str] = (), keep: Column | None = None
    ) -> DataFrame:
        """Replace each drawn column by its noisy value, in a written table.

        Rows that do not satisfy ``keep`` are dropped in the same job and never written.
        """
        scaled = df.withColumns({f"_scale_{d.column}": d.scale_column() for d in draws})
        types = {d.column: T.LongType() if d.whole and not d.grid else T.DoubleType() for d in draws}
        schema = T.StructType([
            T.StructField(f.name, types.get(f.name, f.dataType), True) for f in df.schema.fields
        ])
        names, noisy_values = df.columns, secure.noisy_values
        plan = [(d.column, d.mechanism, d.grid) for d in draws]

        def draw_rows(batches):
            for batch in batches:
                for column, mechanism, grid in plan:
                    batch[column] = noisy_values(mechanism, batch[column], batch[f"_scale_{column}"], grid)
                yield batch[names]

        drawn = scaled.mapInPandas(draw_rows, schema)
        return materialise(drawn if keep is None else drawn.filter(keep))

    def uniform(self, label: str, keys: Sequence[str | Column], stream: int = 1) -> Column:
        return secure.os_uniform(F.concat_ws("|", *keys))

    def coin(self, label: str, keys: Sequence[str | Column], chance: Column) -> Column:
        return secure.os_coin(chance)

    def settle(self, df: DataFrame) -> DataFrame:
        """The written copy of a table that draws noise in its plan."""
        return materialise(df)


Noise = SeededNoise | SecureNoise
