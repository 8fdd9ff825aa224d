"""Joins in which NULL matches NULL, as in a grouping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def null_safe_join(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Columns of ``df``, then (not for semi and anti joins) the columns of ``other`` that are no keys.

    The null-safe comparison also makes Spark shuffle an already grouped ``other`` again, which is what the
    adaptive plan needs to split a key that holds very many rows of ``df``.
    """
    right = other.withColumnsRenamed({c: f"_key_{c}" for c in on})
    same = [df[c].eqNullSafe(right[f"_key_{c}"]) for c in on]
    joined = df.join(right, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*[f"_key_{c}" for c in on])


def null_safe_semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``."""
    return null_safe_join(df, keys.select(*on), on, "left_semi")


def null_safe_anti_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys``."""
    return null_safe_join(df, keys.select(*on), on, "left_anti")
