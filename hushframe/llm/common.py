"""Helpers that the text operators share."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import hushframe

#: How finely a share of all rows can be told by hash.
PARTS = 1 << 30
#: Texts of one id that a sample of labelled rows holds, at most.
TEXTS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers that start from another folder import this package, too."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(hushframe.__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def unused(df: DataFrame, name: str) -> str:
    """The name, made longer until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """The quarter of all documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def share_of(key: Column, share: Column | float) -> Column:
    """A predicate that holds for about this share of all keys, always the same ones."""
    return F.pmod(F.xxhash64(key), F.lit(PARTS)) < F.lit(share) * PARTS


def dealt_evenly(parts: int) -> Column:
    """A part for each row of a written table, by its place there: rows that share an id or a null are spread, too."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """id, text, mark (the text's hash) and label (0 or 1) of at most `bound` training rows.

    Of several labels of a document the largest counts; rows without label are left out. Repeated rows
    are one. Of an id with several texts at most `TEXTS` count, by hash, and the second text of an id
    only where there is room after the first ones of all. The sample is broadcast: the limits are the
    proof of its size, so only texts of the sample are shuffled.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max(F.col(label).cast("double")).alias("label"))
    )
    total = known.count()
    if total > bound:
        known = known.filter(share_of(F.col("id"), 1.1 * bound / total))
    known = known.orderBy(F.xxhash64("id"), "id").limit(bound)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("text"))
    marks = texts.join(F.broadcast(known), "id").select("id", "mark", "label").distinct()
    turn = F.row_number().over(Window.partitionBy("id").orderBy("mark"))
    ranked = marks.withColumn("turn", turn).filter(F.col("turn") <= TEXTS)
    chosen = ranked.orderBy("turn", F.xxhash64("id"), "id").limit(bound).drop("turn")
    found = texts.join(F.broadcast(chosen), ["id", "mark"]).select("id", "text", "mark", "label")
    return found.dropDuplicates(["id", "mark"])


def blocks(texts: list[str | None], limit: int = 1 << 18) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of about `limit` characters: the index of each part's text, and the parts.

    Whole texts where they fit; a longer one is cut behind a space, so no task needs memory for
    more than the text itself and one block. Null and empty texts have no part.
    """
    owners: list[int] = []
    parts: list[str] = []
    room = limit
    for index, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = len(text) if len(text) - at <= limit else max(text.rfind(" ", at, at + limit), text.rfind("\n", at, at + limit)) + 1
            end = end if end > at else at + limit
            if parts and end - at > room:
                yield owners, parts
                owners, parts, room = [], [], limit
            owners.append(index)
            parts.append(text[at:end])
            room -= end - at
            at = end
    if parts:
        yield owners, parts
