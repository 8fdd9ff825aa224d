"""Token counts for every context limit from one exact histogram of lengths.

Documents are aggregated by encoded length. Suffix sums over the lengths (in two steps, inside
blocks of lengths and over blocks) say how many documents and tokens are at least that long, and
with them totals, quantiles and truncated totals for any limit follow from one row.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import importable
from hushframe.plans.materialise import materialise

#: Lengths that share a block of the suffix sums.
BLOCK = 1024

_ENCODERS: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    """One per worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def token_count(docs: DataFrame, path: str, pattern: str, text: str = "text") -> Column:
    """Tokens of each row's whole text by a byte-level vocabulary; null and empty texts have none."""
    importable(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        encode = _encoder(path, pattern).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return run(F.col(text).cast("string"))


def length_histogram(docs: DataFrame, length: Column, block: int = BLOCK) -> DataFrame:
    """One row per length that occurs, with all that answers need.

    length, documents, tokens (of that length), documents_at_least, tokens_at_least,
    truncated_total (tokens left if every document is cut to that length) and documents_up_to.
    A null length counts nowhere. No rows: no rows.
    """
    lengths = docs.select(length.cast("long").alias("length")).filter("length is not null")
    sizes = materialise(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("documents")), "lengths")
    sizes = sizes.withColumn("tokens", F.col("length") * F.col("documents"))
    sizes = sizes.withColumn("block", F.floor(F.col("length") / block))
    documents, tokens = sizes.agg(F.sum("documents"), F.sum("tokens")).first()
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    later = sums.select(
        "block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t")
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    suffix = (
        sizes.withColumn("own_d", F.sum("documents").over(inside))
        .withColumn("own_t", F.sum("tokens").over(inside))
        .join(later, "block")
        .withColumn("documents_at_least", F.col("own_d") + F.col("d"))
        .withColumn("tokens_at_least", F.col("own_t") + F.col("t"))
    )
    below = F.lit(tokens).cast("long") - F.col("tokens_at_least")
    return suffix.select(
        "length", "documents", "tokens", "documents_at_least", "tokens_at_least",
        (below + F.col("length") * F.col("documents_at_least")).alias("truncated_total"),
        (F.lit(documents).cast("long") - F.col("documents_at_least") + F.col("documents")).alias("documents_up_to"),
    )


def truncated_totals(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit, total): tokens left for each context limit, which need not be a length that occurs.

    The smallest length from the limit on decides: what is at least as long is cut to the limit.
    Beyond the longest document nothing is cut, below the shortest everything is. Null limits and an
    empty histogram give a null total.
    """
    ends = histogram.select(
        "length", "documents_at_least", "truncated_total",
        (F.col("truncated_total") - F.col("length") * F.col("documents_at_least")).alias("below"),
    )
    everything = histogram.agg(F.max("truncated_total")).first()[0]
    points = ends.select(F.col("length").alias("at"), F.struct("length", "documents_at_least", "below").alias("row"))
    asked = limits.select(F.col("limit").cast("long").alias("at"), F.lit(None).cast(points.schema["row"].dataType).alias("row"))
    block = F.floor(F.col("at") / BLOCK)
    both = points.unionByName(asked.distinct()).withColumn("block", block)
    inside = Window.partitionBy("block").orderBy(F.desc("at"), F.col("row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    first = both.groupBy("block").agg(F.min("row").alias("least"))
    first = first.select("block", F.last("least", ignorenulls=True).over(carried).alias("next"))
    found = both.withColumn("own", F.last("row", ignorenulls=True).over(inside)).filter("row is null")
    found = found.join(first, found["block"].eqNullSafe(first["block"]), "left").select(
        "at", F.coalesce("own", "next").alias("row")
    )
    total = F.when(F.col("at").isNull(), None).otherwise(
        F.coalesce(F.col("row.below") + F.col("at") * F.col("row.documents_at_least"), F.lit(everything).cast("long"))
    )
    return found.select(F.col("at").alias("limit"), total.alias("total"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that this share of all documents does not exceed."""
    documents = histogram.agg(F.max("documents_up_to")).first()[0]
    least = []
    for share in shares:
        enough = F.col("documents_up_to") >= F.ceil(F.lit(float(share)) * F.lit(documents).cast("double"))
        least.append(F.struct(F.lit(float(share)).alias("share"), F.min(F.when(enough, F.col("length"))).alias("length")))
    return histogram.agg(F.array(*least).alias("rows")).select(F.inline("rows"))
