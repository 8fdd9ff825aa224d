"""Scalar Column expressions: bounds, casts, rounding, missing values, labels, errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_bounds(low: float, high: float) -> None:
    if not low < high:
        raise ValueError(f"lower bound {low} must be below upper bound {high}")


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Force a value into [low, high]; NULL stays NULL and NaN becomes NULL.

    ``least``/``greatest`` alone would turn NULL into a bound, and NaN into the upper one.
    """
    check_bounds(low, high)
    value = _col(c).cast("double")
    inside = F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))
    return F.when(value.isNotNull() & ~F.isnan(value), inside)


def grid_steps(c: Column | str, grid: float) -> Column:
    """The nearest whole number of grid steps; sums of it are exact and do not overflow."""
    return F.floor(_col(c) / F.lit(float(grid)) + F.lit(0.5)).cast("decimal(18,0)")


def cast_or_default(c: Column | str, type_name: str, default: object) -> Column:
    """Cast, and use a constant where the text does not parse."""
    return F.coalesce(_col(c).try_cast(type_name), F.lit(default).cast(type_name))


def half_even(c: Column | str, digits: int = 2) -> Column:
    """Banker's rounding."""
    return F.bround(_col(c), digits)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with NULL or NaN in any of the (numeric) columns."""
    for name in columns:
        df = df.filter(F.col(name).isNotNull() & ~F.isnan(F.col(name)))
    return df


def fill_missing(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """Replace NULL and NaN by a constant per column."""
    filled = {}
    for name, value in values.items():
        c, default = F.col(name), F.lit(value)
        filled[name] = F.when(c.isNull() | F.isnan(c), default).otherwise(c)
    return df.withColumns(filled)


def flag(predicate: Column | str) -> Column:
    """A predicate as 0/1."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return F.coalesce(condition, F.lit(False)).cast("int")


def label(predicate: Column | str, when_true: str, when_false: str) -> Column:
    """One of two labels, e.g. for a count under a threshold in a released table."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return F.when(condition, F.lit(when_true)).otherwise(F.lit(when_false))


def error_columns(truth: Column | str, answer: Column | str, n: Column | str) -> dict[str, Column]:
    """Absolute, relative and size-scaled error; a zero truth or size gives NULL."""
    truth, answer, n = _col(truth), _col(answer), _col(n)
    gap = F.abs(truth - answer)
    return {
        "error": gap,
        "relative_error": F.try_divide(gap, F.abs(truth)),
        "scaled_error": F.try_divide(gap, n),
    }
