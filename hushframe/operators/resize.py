"""Tables of a declared size, and the statistics whose row count is public."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from hushframe.functions.calibration import scale_for
from hushframe.functions.noise import Draw, Noise
from hushframe.functions.scalars import check_bounds, clamp
from hushframe.functions.uniform import HASH_BITS, hash52
from hushframe.plans.materialise import materialise

LEVEL_BITS = 16


def hash_sample(df: DataFrame, n: int, seed: str | int = 0, algorithm: str = "xxhash64") -> DataFrame:
    """Exactly the first n rows in hash order of all columns, or the whole table if it is shorter.

    No global sort. Counts per leading hash bits find the bucket in which the n-th row lies. The hashes of that
    one bucket are written with their counts, and finer bits find the position among them. The sample is then
    a filter on the hash. Each round brings one row to the driver. Equal rows share a hash: of such a group,
    part is cut as a number, and the copies are spread over tasks.
    """
    kept, _ = _cut(df, n, seed, algorithm)
    return kept


#: Copies of a row that one task writes.
COPIES = 100_000


def _crossing(counts: DataFrame, n: int, before: int) -> Row:
    """The first bucket with which ``n`` rows are reached, and the total and sums of the buckets below the cut.

    ``counts`` holds at most 2^16 buckets, one row each, so they may be ordered in one place.
    """
    upto = F.sum("_rows").over(Window.orderBy("_bucket")) + F.lit(before)
    sums = [c for c in counts.columns if c not in ("_bucket", "_rows")]
    running = counts.select("_bucket", "_rows", *sums, upto.alias("_upto"))
    at = F.min(F.when(F.col("_upto") >= n, F.struct("_bucket", "_upto", "_rows", *sums)))
    whole = [F.coalesce(F.sum(F.when(F.col("_upto") <= n, F.col(c))), F.lit(0.0)).alias(c) for c in sums]
    return running.agg(F.max("_upto").alias("total"), at.alias("at"), *whole).first()


def _levels(hashed: DataFrame, n: int):
    """Narrow down where the n-th row in hash order lies.

    ``hashed`` has ``_hash``, of which the whole table is read once for its leading bits and once for the bucket
    found, and columns to add up. Yields one row of ``_crossing`` per level with the lowest hash and the width of
    the bucket found; the last bucket is cut by no row, or is a single hash.
    """
    sums = [c for c in hashed.columns if c != "_hash"]
    added = [F.sum(c).alias(c) for c in sums]
    width, low, before = HASH_BITS - LEVEL_BITS, 0, 0
    top = hashed.groupBy(F.shiftright("_hash", width).alias("_bucket"))
    found = _crossing(top.agg(F.count(F.lit(1)).alias("_rows"), *added), n, 0)
    hashes = None
    while True:
        if found["at"] is not None:
            low += found["at"]["_bucket"] << width
            before = found["at"]["_upto"] - found["at"]["_rows"]
        yield found, low, width
        if found["at"] is None or found["at"]["_upto"] == n or width == 0:
            return
        inside = (F.col("_hash") >= F.lit(low)) & (F.col("_hash") < F.lit(low + (1 << width)))
        if hashes is None:
            inner = hashed.filter(inside).groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows"), *added)
            hashes = materialise(inner, "hashes")
        width = max(width - LEVEL_BITS, 0)
        finer = hashes.filter(inside).groupBy(F.shiftright(F.col("_hash") - F.lit(low), width).alias("_bucket"))
        found = _crossing(finer.agg(F.sum("_rows").alias("_rows"), *added), n, before)


def _cut(df: DataFrame, n: int, seed: str | int, algorithm: str) -> tuple[DataFrame, int]:
    """The sample and its size."""
    if n < 1:
        raise ValueError(f"declared size must be at least 1, got {n}")
    order = hash52(seed, *df.columns, algorithm=algorithm)
    for found, low, width in _levels(df.select(order.alias("_hash")), n):
        at = found["at"]
    if at is None:
        return df, found["total"] or 0
    if at["_upto"] == n:
        return df.filter(order < F.lit(low + (1 << width))), n

    # Rows with the hash ``low`` are copies of one row, or a rare collision of a few different ones.
    missing = n - (at["_upto"] - at["_rows"])
    ties = df.filter(order == F.lit(low)).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    earlier = F.sum("_copies").over(Window.orderBy(*df.columns)) - F.col("_copies")
    take = F.least(F.col("_copies"), F.lit(missing) - earlier)
    taken = ties.withColumn("_take", take).filter("_take > 0")
    chunk = F.explode(F.sequence(F.lit(0), ((F.col("_take") - 1) / COPIES).cast("long")))
    spread = taken.withColumn("_chunk", chunk).repartition("_chunk")
    here = F.least(F.col("_take") - F.col("_chunk") * COPIES, F.lit(COPIES))
    copies = spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), here.cast("long"))))
    return df.filter(order < F.lit(low)).unionAll(copies.select(*df.columns)), n


def resize(
    df: DataFrame, c: str, n: int, constant: float, low: float, high: float,
    seed: str | int = 0, algorithm: str = "xxhash64",
) -> DataFrame:
    """Clamp a column and make the table exactly n rows: sample down, or pad with a constant.

    Padding rows carry the constant in ``c`` and NULL elsewhere.
    """
    check_bounds(low, high)
    if not low <= constant <= high:
        raise ValueError(f"padding constant {constant} lies outside [{low}, {high}]")
    kept, size = _cut(df, n, seed, algorithm)
    kept = kept.withColumn(c, F.coalesce(clamp(c, low, high), F.lit(float(constant))))
    if size >= n:
        return kept
    pad = [
        (F.lit(float(constant)) if f.name == c else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in kept.schema.fields
    ]
    return kept.unionAll(df.sparkSession.range(n - size).select(*pad))


def _sized_moments(df, c, low, high, n, constant, seed, algorithm) -> DataFrame:
    """Moments of the resized column in two reads of the table; padding and cut copies are added as numbers.

    The sums travel with the counts per hash bucket: buckets below the cut are finished by the first read, and
    only the bucket of the cut is read again. Of rows that share the hash of the cut, each counts as their mean.
    """
    check_bounds(low, high)
    if not low <= constant <= high:
        raise ValueError(f"padding constant {constant} lies outside [{low}, {high}]")
    if n < 1:
        raise ValueError(f"declared size must be at least 1, got {n}")
    middle = (low + high) / 2.0
    y = F.coalesce(clamp(c, low, high), F.lit(float(constant))) - F.lit(middle)
    order = hash52(seed, *df.columns, algorithm=algorithm)
    hashed = df.select(order.alias("_hash"), y.alias("_y")).withColumn("_yy", F.col("_y") * F.col("_y"))
    first = second = 0.0
    for found, _, _ in _levels(hashed, n):
        first, second, at = first + found["_y"], second + found["_yy"], found["at"]
    if at is None:
        missing, pad = n - (found["total"] or 0), constant - middle
        first, second = first + missing * pad, second + missing * pad * pad
    elif at["_upto"] > n:
        share = (n - (at["_upto"] - at["_rows"])) / at["_rows"]
        first, second = first + share * at["_y"], second + share * at["_yy"]
    return df.sparkSession.range(1).select(F.lit(float(first)).alias("m1"), F.lit(float(second)).alias("m2"))


def dp_sum_sized(
    df: DataFrame, c: str, low: float, high: float, n: int, epsilon: float, noise: Noise, *,
    constant: float | None = None, seed: str | int = 0, algorithm: str = "xxhash64",
) -> DataFrame:
    """Private sum of n declared rows: changing one row moves it by at most high - low."""
    constant = low if constant is None else constant
    moments = _sized_moments(df, c, low, high, n, constant, seed, algorithm)
    total = F.col("m1") + F.lit(n * (low + high) / 2.0)
    draw = Draw("sum", "laplace", scale_for(high - low, epsilon))
    return noise.add(moments.select(total.alias("sum")), [draw])


def dp_mean_sized(
    df: DataFrame, c: str, low: float, high: float, n: int, epsilon: float, noise: Noise, *,
    constant: float | None = None, seed: str | int = 0, algorithm: str = "xxhash64",
) -> DataFrame:
    """Private mean of n declared rows."""
    constant = low if constant is None else constant
    moments = _sized_moments(df, c, low, high, n, constant, seed, algorithm)
    mean = F.col("m1") / F.lit(float(n)) + F.lit((low + high) / 2.0)
    draw = Draw("mean", "laplace", scale_for((high - low) / n, epsilon))
    return noise.add(moments.select(mean.alias("mean")), [draw])


def variance_sensitivity(low: float, high: float, n: int, ddof: int = 0) -> float:
    """How far changing one of n rows can move the variance."""
    width = (high - low) ** 2
    return width * (n - 1) / n**2 if ddof == 0 else width / n


def dp_variance_sized(
    df: DataFrame, c: str, low: float, high: float, n: int, epsilon: float, noise: Noise, *,
    ddof: int = 0, constant: float | None = None, seed: str | int = 0, algorithm: str = "xxhash64",
) -> DataFrame:
    """Private variance of n declared rows, population (ddof 0) or sample (ddof 1)."""
    if n < 2:
        raise ValueError("a variance needs a declared size of at least 2")
    constant = low if constant is None else constant
    moments = _sized_moments(df, c, low, high, n, constant, seed, algorithm)
    mean = F.col("m1") / F.lit(float(n))
    variance = (F.col("m2") - F.col("m1") * mean) / F.lit(float(n - ddof))
    draw = Draw("variance", "laplace", scale_for(variance_sensitivity(low, high, n, ddof), epsilon))
    return noise.add(moments.select(variance.alias("variance")), [draw])
