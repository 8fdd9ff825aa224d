"""Public key sets and the joins of private tables.

No join carries a broadcast hint: the optimizer and the adaptive plan compare the side's actual size
with the broadcast threshold and otherwise shuffle, splitting hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators.bounding import truncate_rows
from hushframe.operators.matching import null_safe_semi_join

#: Longer declared domains become a table of their own.
LITERALS = 256
#: Parts that a product deals the second key set into, at most.
PARTS = 4096
MARKER = "_listed"


def join_public(df: DataFrame, public: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi join of a private table with a public one."""
    return df.join(public, list(on), "inner")


def public_multiplicity(public: DataFrame, on: Sequence[str]) -> int:
    """How many rows one private row can become in ``join_public``: the factor on the sensitivity."""
    copies = public.groupBy(*on).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(F.coalesce(F.max("copies"), F.lit(0))).first()[0]


def join_private(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_rows: int,
    right_rows: int,
    left_order: Sequence[str],
    right_order: Sequence[str],
    seed: str | int = 0,
    algorithm: str = "xxhash64",
) -> DataFrame:
    """Join two private tables after keeping at most so many rows per key on each side."""
    a = truncate_rows(left, on, left_rows, left_order, seed, algorithm)
    b = truncate_rows(right, on, right_rows, right_order, seed, algorithm)
    return a.join(b, list(on), "inner")


def restrict_to_keys(df: DataFrame, keyset: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in the key set."""
    return null_safe_semi_join(df, keyset, keys)


def aggregate_on_keyset(
    df: DataFrame, keyset: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]
) -> DataFrame:
    """Exactly one row per public key, also for keys that no private row has.

    The keys are stacked below the private rows as markers and grouped with them: one shuffle, no join,
    NULL is a key like any other, and a key that was listed twice is still released once. Aggregates must
    not see the markers: use ``private_rows()`` to count, and functions that skip NULL otherwise.
    """
    markers = keyset.select(*keys).withColumn(MARKER, F.lit(1))
    stacked = df.withColumn(MARKER, F.lit(0)).unionByName(markers, allowMissingColumns=True)
    listed = F.max(MARKER).alias(MARKER)
    grouped = stacked.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()], listed)
    return grouped.filter(F.col(MARKER) == 1).drop(MARKER)


def private_rows() -> Column:
    """Number of rows that are no markers of ``aggregate_on_keyset``."""
    return F.count(F.when(F.col(MARKER) == 0, 1))


def declared_keys(spark: SparkSession, domains: Mapping[str, Sequence[object]]) -> DataFrame:
    """A key set from declared domains: every combination of their values."""
    return with_domains(spark.range(1), domains).drop("id")


def with_domains(df: DataFrame, domains: Mapping[str, Sequence[object]]) -> DataFrame:
    """Attach every combination of the declared domains, of any length, to the keys of ``df``."""
    for name, values in domains.items():
        if len(values) > LITERALS:
            schema = df.sparkSession.range(1).select(F.lit(values[0]).alias(name)).schema
            schema[name].nullable = True
            df = keyset_product(df, df.sparkSession.createDataFrame([(v,) for v in values], schema))
        else:
            df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def keyset_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every combination of two public key sets of any size.

    The second set is dealt by hash into parts, the first one is unfolded over the numbers of the parts, and
    both meet by that number: an equi join without a hot key. Only the size of the second set, which sets
    the number of parts, reaches the driver.
    """
    parts = max(1, min(b.count(), PARTS))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    mine = F.pmod(F.xxhash64(*[F.col(c) for c in b.columns]), F.lit(parts)).cast("int")
    return a.withColumn("_part", every).join(b.withColumn("_part", mine), "_part").drop("_part")
