"""Contribution bounding: how many partitions, and rows per partition, one privacy unit may touch.

Which rows stay is decided by a hash, so a re-run keeps the same rows. The rank filter sits directly
on each window: Spark then keeps at most the first k rows of each key inside every task before the
shuffle, so a unit that holds a third of the table sends a handful of rows, not a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from hushframe.functions.uniform import HASH_BITS, hash52
from hushframe.operators.matching import null_safe_join, null_safe_semi_join

RANK = "_rank"
#: Leading bits of the hash that cut the rows of a key into slices.
SLICE_BITS = 12


@dataclass(frozen=True)
class PrivacyUnit:
    """Who is protected and how much one of them may contribute.

    ``column`` names the id of the unit; ``None`` protects single rows, of which one person
    influences at most ``rows`` (nothing is dropped then). With an id, rows beyond ``rows`` per
    partition and partitions beyond ``partitions`` are dropped before aggregating. ``row_key``
    names columns that identify a row; without it all columns decide. Rows whose id is NULL belong to
    nobody in particular: ``missing`` says whether they are dropped or the job is refused.
    """

    column: str | None = None
    partitions: int = 1
    rows: int = 1
    row_key: tuple[str, ...] = ()
    seed: str | int = 0
    algorithm: str = "xxhash64"
    missing: str = "drop"

    def __post_init__(self) -> None:
        if self.missing not in ("drop", "refuse"):
            raise ValueError(f"rows without an id are dropped or refused, not {self.missing}")
        if self.partitions < 1 or self.rows < 1:
            raise ValueError("contribution bounds must be at least 1")


ROW = PrivacyUnit()


def _order(df: DataFrame, unit: PrivacyUnit) -> list[Column]:
    """By the hash of the row key, then the key; rows that share a key by their other columns."""
    key = list(unit.row_key) or df.columns
    rest = [f.name for f in df.schema if f.name not in key and not isinstance(f.dataType, (MapType, VariantType))]
    return [hash52(unit.seed, *key, algorithm=unit.algorithm), *[F.col(c) for c in (*key, *rest)]]


def known_units(df: DataFrame, unit: PrivacyUnit) -> DataFrame:
    """Rows that have an id, as the unit's ``missing`` says."""
    if unit.column is None:
        return df
    known = F.col(unit.column).isNotNull()
    if unit.missing == "refuse":
        known = known | F.raise_error(F.lit(f"a row has no {unit.column}")).cast("boolean")
    return df.filter(known)


def _keep_ranked(
    df: DataFrame, distinct: bool, name: str, keys: Sequence[str], k: int, order: Sequence[Column]
) -> DataFrame:
    """Rows whose rank (dense, if ``distinct``) among the rows of their key is at most k.

    Spark filters by rank inside the tasks only up to a certain k. For a larger k the rows of a key are counted
    in slices by the leading bits of their hash, by which they are ordered. Slices that begin beyond k are
    dropped, and the others are ranked each for itself, behind the count of the slices before: no task ever
    sees more of a busy key than one slice.
    """
    rank = F.dense_rank() if distinct else F.row_number()
    if k <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, rank.over(whole)).filter(F.col(name) <= F.lit(k))
    slice_of = F.shiftright(order[0], HASH_BITS - SLICE_BITS).cast("int")
    df = df.withColumn("_slice", slice_of)
    ranked = df.select(*keys, "_slice", *[c.alias(f"_o{i}") for i, c in enumerate(order)]) if distinct else df
    sizes = (ranked.distinct() if distinct else ranked).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_slice"))
    opened = sizes.withColumn("_before", upto - F.col("_size")).filter(F.col("_before") < F.lit(k)).drop("_size")
    inside = rank.over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    kept = null_safe_join(df, opened, [*keys, "_slice"])
    kept = kept.withColumn(name, (F.col("_before") + inside).cast("int")).filter(F.col(name) <= F.lit(k))
    return kept.drop("_slice", "_before")


def first_rows(df: DataFrame, keys: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """At most k rows per key, first in the given order (a hash, then ties); ``_rank`` keeps the position."""
    return _keep_ranked(df, False, RANK, keys, k, order)


def bound_rows(df: DataFrame, unit: PrivacyUnit, by: Sequence[str] = ()) -> DataFrame:
    """At most ``unit.rows`` rows per privacy unit and partition."""
    kept = first_rows(known_units(df, unit), [unit.column, *by], unit.rows, _order(df, unit))
    return kept.drop(RANK)


def contributed_partitions(
    df: DataFrame, unit: PrivacyUnit, by: Sequence[str], keyset: DataFrame | None = None
) -> DataFrame:
    """Distinct (unit, partition) pairs, at most ``unit.partitions`` per unit, all in the key set if given.

    Pairs are made distinct inside each task first, so copies of a hot pair never travel.
    """
    pairs = known_units(df, unit).select(unit.column, *by).distinct()
    if keyset is not None:
        pairs = null_safe_semi_join(pairs, keyset, by)
    return first_rows(pairs, [unit.column], unit.partitions, _pair_order(unit, by)).drop(RANK)


def _pair_order(unit: PrivacyUnit, by: Sequence[str]) -> list[Column]:
    return [hash52(unit.seed, unit.column, *by, algorithm=unit.algorithm), *[F.col(c) for c in by]]


def bound_partitions(df: DataFrame, unit: PrivacyUnit, by: Sequence[str]) -> DataFrame:
    """All rows of at most ``unit.partitions`` partitions per privacy unit.

    Ranks the distinct pairs, not the rows, and keeps the rows by a semi join: a pair with very
    many rows is split by the skew handling of the adaptive join instead of filling one window.
    """
    keep = contributed_partitions(df, unit, by)
    return null_safe_semi_join(df, keep, [unit.column, *by])


def bound_contributions(
    df: DataFrame, unit: PrivacyUnit, by: Sequence[str] = (), keyset: DataFrame | None = None
) -> DataFrame:
    """Both bounds at once; ``_rank`` = 1 marks one row per (unit, partition).

    Rows are bounded first, so that the key set and the partition ranking see at most ``rows`` rows per
    pair. Neither changes which rows of a pair are kept.
    """
    kept = first_rows(known_units(df, unit), [unit.column, *by], unit.rows, _order(df, unit))
    return _bound_pairs(kept, unit, by, keyset)


def one_value_each(
    df: DataFrame, value: str, unit: PrivacyUnit, by: Sequence[str] = (), keyset: DataFrame | None = None
) -> DataFrame:
    """``bound_contributions`` for one row per pair, when only ``value`` is needed of it.

    The row with the smallest hash is found by a hash aggregate, without sorting the table. Of rows that share a
    row key, which have one hash, the value decides by its own hash, so the order of the file never does.
    """
    tie = F.xxhash64(value).cast("decimal(20,0)") + F.lit(Decimal(2**63))
    first = _order(df, unit)[0].cast("decimal(16,0)") * F.lit(Decimal(2**64)) + tie
    kept = known_units(df, unit).groupBy(unit.column, *by).agg(F.min_by(value, first).alias(value))
    return _bound_pairs(kept.withColumn(RANK, F.lit(1)), unit, by, keyset)


def _bound_pairs(kept: DataFrame, unit: PrivacyUnit, by: Sequence[str], keyset: DataFrame | None) -> DataFrame:
    if not by:
        return kept
    if keyset is not None:
        kept = null_safe_semi_join(kept, keyset, by)
    pairs = _keep_ranked(kept, True, "_pair", [unit.column], unit.partitions, _pair_order(unit, by))
    return pairs.drop("_pair")


def truncate_rows(
    df: DataFrame, keys: Sequence[str], k: int, order_by: Sequence[str], seed: str | int = 0, algorithm: str = "xxhash64"
) -> DataFrame:
    """At most k rows per key, in hash order of ``order_by``, which must tell the rows of a key apart.

    With a group among the keys this bounds the rows per key and group.
    """
    order = [hash52(seed, *order_by, algorithm=algorithm), *[F.col(c) for c in order_by]]
    return first_rows(df, keys, k, order).drop(RANK)


def truncate_groups(
    df: DataFrame, keys: Sequence[str], groups: Sequence[str], k: int, seed: str | int = 0, algorithm: str = "xxhash64"
) -> DataFrame:
    """All rows of at most k groups per key, e.g. at most k orders per customer."""
    pairs = df.select(*keys, *groups).distinct()
    order = [hash52(seed, *keys, *groups, algorithm=algorithm), *[F.col(c) for c in groups]]
    keep = first_rows(pairs, keys, k, order).drop(RANK)
    return null_safe_semi_join(df, keep, [*keys, *groups])
