"""Connected components of a link table by alternating stars.

Each round first links every node's larger neighbours to its smallest one, then its smaller
neighbours likewise, and writes the links. Links never cross components and the rounds end when
nothing changes: every node then hangs on its component's smallest node. Stars are found by
aggregates and joins, so a node with a third of all links is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.plans.materialise import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to the least of them."""
    if large:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = links
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = ends.join(least, "a")
    if large:
        return moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of `links` (a, b) that is not its component's smallest.

    Links may repeat, run either way and join a node to itself. No link: no row.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    before = None
    while True:
        links = materialise(links, "links")
        row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1000003)).first()
        now = tuple(row)
        if now[0] == 0 or now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        links = _star(_star(links, True), False)
