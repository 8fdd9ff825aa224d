"""Reproducible uniforms made from row keys.

A keyed hash gives the same number for the same key on any cluster layout, which
``rand(seed)`` does not: its stream depends on how rows fall into partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52
TWO_52 = 4503599627370496.0


def hash52(seed: str | int, *parts: Column | str, algorithm: str = "xxhash64") -> Column:
    """A whole number in [0, 2^52) from the seed and the parts.

    A text part names a column; a constant needs ``F.lit``. ``xxhash64`` reads the columns as they are
    and costs about a tenth of ``md5``, which hashes the text ``seed|part|part|...`` and can therefore be
    re-computed by any SQL engine. NULL is a value of its own, and texts that hold the separator are
    told apart: (NULL, 'x') and ('x', NULL) differ, and so do ('a|', 'b') and ('a', '|b').
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    if algorithm == "xxhash64":
        missing = [F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(cols)]
        places = F.nullif(reduce(lambda a, b: a + b, missing), F.lit(0)) if cols else F.lit(None).cast("int")
        return F.shiftrightunsigned(F.xxhash64(F.lit(str(seed)), *cols, places), 12)
    if algorithm == "md5":
        text = F.concat_ws("|", F.lit(str(seed)), *[_escaped(c) for c in cols])
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    raise ValueError(f"unknown hash algorithm: {algorithm}")


def _escaped(c: Column) -> Column:
    """The value as a text without a bare separator; NULL is an escape that no text gives."""
    text = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(text, F.lit("\\0"))


def uniform(seed: str | int, *parts: Column | str, algorithm: str = "xxhash64") -> Column:
    """A double strictly between 0 and 1."""
    return (hash52(seed, *parts, algorithm=algorithm).cast("double") + 0.5) / F.lit(TWO_52)
