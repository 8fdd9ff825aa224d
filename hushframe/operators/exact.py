"""Exact aggregates: the ground truth that private answers are compared with.

All of them are partial + final hash aggregates; nothing here releases anything private.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = ("rows", "count", "sum", "mean", "var_samp", "var_pop", "stddev_samp", "stddev_pop", "min", "max")


def exact_columns(c: Column | str) -> dict[str, Column]:
    """Every exact statistic of one column, to be used in a single ``agg``."""
    v = F.col(c) if isinstance(c, str) else c
    return {
        "rows": F.count(F.lit(1)),
        "count": F.count(v),
        "sum": F.sum(v),
        "mean": F.avg(v),
        "var_samp": F.var_samp(v),
        "var_pop": F.var_pop(v),
        "stddev_samp": F.stddev_samp(v),
        "stddev_pop": F.stddev_pop(v),
        "min": F.min(v),
        "max": F.max(v),
    }


def exact_stats(
    df: DataFrame, c: Column | str, stats: Sequence[str] = EXACT, by: Sequence[str] = ()
) -> DataFrame:
    """The chosen statistics in one pass over the table."""
    available = exact_columns(c)
    return df.groupBy(*by).agg(*[available[s].alias(s) for s in stats])
