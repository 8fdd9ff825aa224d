"""Distances between tables, as used to test how far a step can move neighbouring inputs.

Two tables are compared by stacking them with weights +1 and -1 and adding up equal rows. That is a
hash aggregation with map-side combining, so that a row or key with very many copies is no hot spot,
and no join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.keysets import restrict_to_keys
from hushframe.operators.matching import null_safe_anti_join


def net_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows with ``_a`` and ``_b``, how often each table has them."""
    left = a.withColumns({"_a": F.lit(1), "_b": F.lit(0)})
    right = b.withColumns({"_a": F.lit(0), "_b": F.lit(1)})
    stacked = left.unionByName(right)
    return stacked.groupBy(*a.columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))


def _gap() -> Column:
    return F.abs(F.col("_a") - F.col("_b"))


def absolute_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distance of two numbers, each the only value of a one-row table."""
    left = a.select(F.col(a.columns[0]).alias("_x"))
    right = b.select((-F.col(b.columns[0])).alias("_x"))
    return left.unionAll(right).agg(F.abs(F.sum("_x")).alias("distance"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows to add or remove to turn one multiset into the other."""
    return net_rows(a, b).agg(F.coalesce(F.sum(_gap()), F.lit(0)).alias("distance"))


def grouped_symmetric_difference(
    a: DataFrame, b: DataFrame, keyset: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """The same within the groups of a key set: differing rows, and groups that differ at all."""
    nets = restrict_to_keys(net_rows(a, b), keyset, keys)
    per_group = nets.groupBy(*keys).agg(F.sum(_gap()).alias("_rows"))
    return per_group.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("row_distance"),
        F.count(F.when(F.col("_rows") > 0, 1)).alias("group_distance"),
    )


def hamming(a: DataFrame, b: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """Row keys whose rows differ: the change-one distance."""
    per_key = net_rows(a, b).groupBy(*row_key).agg(F.max(_gap()).alias("_gap"))
    return per_key.agg(F.count(F.when(F.col("_gap") > 0, 1)).alias("distance"))


def aligned_gaps(a: DataFrame, b: DataFrame, row_key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per row key the absolute difference of each column; a key must be unique and on both sides.

    A value that is NULL on both sides has not changed; one that is NULL on one side only has no distance: that raises.
    """
    wanted = [*row_key, *columns]
    left = a.select(*wanted, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    right = b.select(*wanted, F.lit(0).alias("_a"), F.lit(1).alias("_b"))

    def side(c: str, mark: str) -> Column:
        return F.max(F.when(F.col(mark) == 1, F.col(c)))

    def gap(c: str) -> Column:
        a, b = side(c, "_a"), side(c, "_b")
        one_sided = F.raise_error(F.lit(f"{c} is NULL on one side only"))
        known = F.when(a.isNull() & b.isNull(), F.lit(0)).when(a.isNotNull() & b.isNotNull(), F.abs(a - b))
        return F.when(a.isNull() != b.isNull(), one_sided).otherwise(known).alias(c)

    gaps = [gap(c) for c in columns]
    paired = (F.sum("_a") == 1) & (F.sum("_b") == 1)
    checked = F.when(paired, F.lit(True)).otherwise(
        F.raise_error(F.lit("row key is not unique or missing on one side")).cast("boolean")
    )
    rows = left.unionAll(right).groupBy(*row_key).agg(checked.alias("_paired"), *gaps)
    return rows.filter("_paired").drop("_paired")


def on_columns(
    a: DataFrame, b: DataFrame, row_key: Sequence[str], metrics: Mapping[str, str]
) -> DataFrame:
    """One distance per column: ``sum`` or ``root_sum_squares`` of the row-wise differences."""
    known = {
        "sum": lambda c: F.sum(c),
        "root_sum_squares": lambda c: F.sqrt(F.sum(F.col(c).cast("double") * F.col(c))),
    }
    gaps = aligned_gaps(a, b, row_key, list(metrics))
    return gaps.agg(*[F.coalesce(known[m](c), F.lit(0)).alias(c) for c, m in metrics.items()])


def dict_metric(distances: Mapping[str, DataFrame]) -> DataFrame:
    """Named one-value distances as rows (name, distance)."""
    rows = [
        d.select(F.lit(name).alias("name"), F.col(d.columns[0]).cast("double").alias("distance"))
        for name, d in distances.items()
    ]
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionAll(row)
    return stacked


def add_remove_keys(tables: Mapping[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Keys to add or remove over several tables ``name: (a, b, key column)``.

    A key that only one side has costs 1; a key whose rows differ in any table costs 2, as it is
    removed and added again. Multisets of rows are compared exactly, without digests.
    """
    stacked: DataFrame | None = None
    for a, b, key in tables.values():
        per_key = net_rows(a, b).groupBy(F.col(key).cast("string").alias("key")).agg(
            F.max(F.col("_a") > 0).alias("in_a"),
            F.max(F.col("_b") > 0).alias("in_b"),
            F.max(_gap() > 0).alias("differs"),
        )
        stacked = per_key if stacked is None else stacked.unionAll(per_key)
    keys = stacked.groupBy("key").agg(
        F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"), F.max("differs").alias("differs")
    )
    cost = F.when(F.col("in_a") != F.col("in_b"), 1).when(F.col("differs"), 2).otherwise(0)
    return keys.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("distance"))


def if_grouped_by(a: DataFrame, b: DataFrame, c: str, outer: str = "sum") -> DataFrame:
    """Row distance within each value of ``c``, combined by ``sum`` or ``root_sum_squares``."""
    per_group = net_rows(a, b).groupBy(c).agg(F.sum(_gap()).alias("_rows"))
    if outer == "sum":
        total = F.sum("_rows")
    elif outer == "root_sum_squares":
        total = F.sqrt(F.sum(F.col("_rows").cast("double") * F.col("_rows")))
    else:
        raise ValueError(f"unknown outer metric: {outer}")
    return per_group.agg(F.coalesce(total, F.lit(0)).alias("distance"))


def remove_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without all rows of the given keys."""
    return null_safe_anti_join(df, keys, [key])


def add_keys(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with all rows of further keys."""
    return df.unionByName(rows)
