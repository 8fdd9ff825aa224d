"""Row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.plans.materialise import materialise


def with_privacy_id(df: DataFrame, name: str = "id") -> DataFrame:
    """A different number per row; gaps between tasks, no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id() + 1)


def with_line_number(df: DataFrame, name: str = "id") -> DataFrame:
    """Numbers 1..n without gaps.

    The rows of files that know their rows' places (Parquet) are numbered in the order of file names, then places:
    rows per file are counted from the files alone, and nothing is written. Any other table is numbered in the order of its
    tasks; its task-local numbers are written once, so that a re-computed task cannot shift them. Only one row
    per file or task is ordered in one place.
    """
    if _rows_of_files(df):
        meta = df.metadataColumn("_metadata")
        placed = df.select("*", meta["file_path"].alias("_file"), meta["row_index"].alias("_place"))
    else:
        tagged = materialise(df.withColumn("_at", F.monotonically_increasing_id()), "line-numbers")
        place = F.col("_at").bitwiseAND((1 << 33) - 1)
        placed = tagged.withColumns({"_file": F.shiftright("_at", 33), "_place": place})
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_offset"))
    numbered = placed.join(F.broadcast(offsets), "_file")
    return numbered.select(*df.columns, (F.col("_offset") + F.col("_place") + 1).alias(name))


def id_statistics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """name, n (ids that are not null), first, last, ids (different ones) per column of whole numbers.

    A group is a run of 64 neighbouring numbers with a bit for each, so dense ids need memory for one group in 64 rows.
    """
    each = [F.struct(F.lit(name).alias("name"), F.col(name).cast("bigint").alias("id")) for name in names]
    ids = df.select(F.inline(F.array(*each))).filter(F.col("id").isNotNull())
    bit = F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    runs = ids.groupBy("name", F.shiftright("id", 6).alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.bit_or(bit).alias("bits")
    )
    return runs.groupBy("name").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum(F.bit_count("bits").cast("bigint")).alias("ids"),
    )


def _rows_of_files(df: DataFrame) -> bool:
    """Whether the rows are all rows of files, each once, and have their places: a scan with columns chosen or computed."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias"):
        node = node.child()
    if node.nodeName() != "LogicalRelation":
        return False
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return False
    return True


def with_unique_id(df: DataFrame, name: str = "id") -> DataFrame:
    """An id from the content of the row, with a copy number that tells equal rows apart.

    The id is the digest and the number of the copy. Copies are counted, and numbered inside spread-out slices
    of the count, so that a row with very many copies is no hot spot.
    """
    digest = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    chunk = 100_000
    last = F.floor((F.col("_copies") - 1) / chunk)
    chunks = copies.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    spread = chunks.repartition("_chunk", *df.columns)
    start = F.col("_chunk") * chunk + 1
    stop = F.least(F.col("_copies"), (F.col("_chunk") + 1) * chunk)
    numbered = spread.withColumn("_copy", F.explode(F.sequence(start, stop)))
    return numbered.select(*df.columns, F.concat_ws("-", digest, F.col("_copy")).alias(name))
