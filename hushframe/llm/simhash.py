"""Near duplicates by 64-bit SimHash and bit-sliced comparison.

Every text becomes a fingerprint; equal fingerprints are one node. Two fingerprints within the
radius agree on at least two of radius + 2 blocks of bits, so rows are dealt by each pair of blocks
and compared only with rows that agree there. The comparison stores bit planes vertically: one
plane holds one bit of many rows, one machine operation updates as many distances, kept in
carry-save counters, and a block of rows is abandoned once all its distances exceed the radius.

A bucket beyond `tile` rows is cut into chunks, and all pairs of chunks are compared in tasks of
their own: no bucket is cut short and none meets in one task. A task returns links that span its
rows' components instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import importable, unused
from hushframe.llm.components import components
from hushframe.plans.materialise import materialise

SEED = 42
#: Rows of a bucket that one task compares; larger buckets are cut into chunks of this many.
TILE = 4096
#: Rows (bits of a plane) that are compared, and abandoned, together.
BLOCK = 1 << 15


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number.

    A-Z are lower-cased, words are what white space (space, 9 to 13) separates, shingles have `size`
    words and count as often as they occur; with fewer words the whole sequence is the shingle, and
    without any the fingerprint is zero. A bit is set if over half of the shingles' XXH64 have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - size + 1)].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = [digest(data[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])]
        planes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(planes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """id and print (signed long) of each row."""
    importable(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "print"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, print long")


def as_hex(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def block_masks(radius: int) -> list[int]:
    """Signed 64-bit masks of each pair of radius + 2 blocks that together cover all bits."""
    count = radius + 2
    edges = [64 * i // count for i in range(count + 1)]
    single = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    pairs = [a | b for a, b in combinations(single, 2)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in pairs]


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all fingerprints, eight to a byte."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def near(first: np.ndarray, second: np.ndarray, radius: int) -> np.ndarray:
    """Bytes whose bits tell which columns of two plane tables differ in at most `radius` planes."""
    width = radius.bit_length()
    counters = [np.zeros(first.shape[1], np.uint8) for _ in range(width)]
    over = np.zeros(first.shape[1], np.uint8)
    for plane in range(first.shape[0]):
        carry = first[plane] ^ second[plane]
        for j in range(width):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if plane % 8 == 7:
            exceeded = over | _above(counters, radius)
            if (exceeded == 255).all():
                break
    return ~(over | _above(counters, radius))


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits whose counters exceed the radius, most significant counter first."""
    above = np.zeros_like(counters[0]) if counters else np.zeros(0, np.uint8)
    same = ~above
    for j in reversed(range(len(counters))):
        if radius >> j & 1:
            same &= counters[j]
        else:
            above |= same & counters[j]
            same &= ~counters[j]
    return above


def near_pairs(group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of rows of a group within the radius. Rows come ordered by group.

    Row i is compared with row i + shift, for all rows at once and every shift that a group spans.
    A group leaves the tables once the shift has passed its size.
    """
    sizes = np.unique(group, return_counts=True)[1]
    size = np.repeat(sizes, sizes)
    at = np.arange(len(group))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    shift, planes, until = 0, {}, 0
    while len(at):
        shift += 1
        if shift >= until or shift == 1:
            at = at[size[at] > shift]
            if not len(at):
                break
            until = 2 * shift
            planes = {0: bit_planes(prints[at])}
        if shift >= len(at):
            break
        skip, turn = divmod(shift, 8)
        if turn not in planes:
            planes[turn] = bit_planes(prints[at][turn:])
        count = len(at) - shift
        total = (count + 7) // 8
        for low in range(0, total, BLOCK // 8):
            high = min(total, low + BLOCK // 8)
            close = near(planes[0][:, low:high], planes[turn][:, skip + low : skip + high], radius)
            if close.any():
                hits = np.flatnonzero(np.unpackbits(close, bitorder="little")) + 8 * low
                hits = hits[hits < count]
                hits = hits[group[at[hits]] == group[at[hits + shift]]]
                left.append(at[hits])
                right.append(at[hits + shift])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def spanning_links(prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row to the first row of its component: as many as rows, however many pairs."""
    root = np.arange(len(prints))
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        for ends in (left, right, root[left], root[right]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(root)))
    return prints[moved], prints[root[moved]]


def _compare(radius: int, rows: int = 1 << 17):
    """Turn batches ordered by (table, key, low, high) into links; a group may go over batches."""

    def flush(table: pa.Table) -> pa.RecordBatch | None:
        keys = np.stack([table.column(i).to_numpy().astype(np.int64) for i in range(4)])
        group = np.cumsum(np.r_[0, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if keys.shape[1] else np.zeros(0, int)
        prints = table.column(4).to_numpy().astype(np.int64)
        left, right = near_pairs(group, prints.view(np.uint64), radius)
        a, b = spanning_links(prints, left, right)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def last_group(table: pa.Table) -> int:
        """Where the last group begins."""
        differs = np.zeros(table.num_rows, bool)
        for i in range(4):
            column = table.column(i).to_numpy()
            differs |= column != column[-1]
        return int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                table = pa.Table.from_batches(held)
                cut = last_group(table)
                if cut:
                    yield flush(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    count = table.num_rows - cut
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def near_links(prints: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius; `prints` has each print once."""
    importable(prints.sparkSession)
    keys = F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(mask)).alias("key"))
        for i, mask in enumerate(block_masks(radius))
    ])
    dealt = prints.select("print", F.explode(keys).alias("k")).select("k.part", "k.key", "print")
    several = dealt.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    tiles = (
        dealt.join(several, ["part", "key"])
        .select("part", "key", "print", chunks.alias("chunks"))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("part", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "print")
    )
    place = ["part", "key", "low", "high"]
    ordered = tiles.repartition(*place).sortWithinPartitions(*place, "print")
    return ordered.mapInArrow(_compare(radius), "a long, b long")


def _groups(docs: DataFrame, doc_id: str, text: str, size: int, radius: int) -> DataFrame:
    """id, print, root (a print that names the component, ids or not) and component_id of each row of `docs`."""
    rows = materialise(fingerprints(docs, doc_id, text, size), "simhash-prints")
    nodes = materialise(rows.groupBy("print").agg(F.min("id").alias("least")), "simhash-nodes")
    found = components(near_links(nodes.select("print"), radius))
    rooted = nodes.join(found, nodes["print"] == found["node"], "left").select(
        "print", "least", F.coalesce("component", "print").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("print", "root", "component_id")
    return rows.join(named, "print").select("id", "print", "root", "component_id")


def simhash_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of `docs`.

    Documents are linked when their fingerprints differ in at most `radius` bits; component_id is the
    smallest id that links reach. Null and empty texts have fingerprint zero and are linked like
    others, so are repeated rows. A null id takes part, but never names a component unless all ids of
    it are null. Other columns are not read.
    """
    return _groups(docs, doc_id, text, size, radius).select(
        F.col("id").alias(doc_id), as_hex(F.col("print")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2
) -> DataFrame:
    """The rows of `docs` that stay, with all columns: of each component the document with the smallest id.

    Rows are told by their id. Where an id is on several rows, or null, some of which stay, its rows are
    told by id and fingerprint, and only those in a component that the id names stay. Repeated rows of
    that id in its component are one document: one row of each text stays. A component without any id
    keeps one row, the first by text.
    """
    groups = materialise(_groups(docs, doc_id, text, size, radius), "simhash-groups")
    same = F.col("id").eqNullSafe(F.col("component_id"))
    by_id = materialise(
        groups.groupBy(F.col("id").alias("gone_id"))
        .agg(F.count_if(same).alias("stay"), F.count_if(~same).alias("go"))
        .filter("stay = 0 or stay + go > 1"),
        "simhash-gone",
    )
    gone = by_id.filter("stay = 0")
    both = by_id.filter("stay > 0")
    left = docs.join(gone, docs[doc_id].eqNullSafe(gone["gone_id"]), "left_anti")
    if both.isEmpty():
        return left
    plain = left.join(both, left[doc_id].eqNullSafe(both["gone_id"]), "left_anti")
    mark, root, rank = (unused(docs, name) for name in ("near_print", "near_root", "near_rank"))
    kept = groups.filter(same).select(F.col("id").alias("kept_id"), F.col("print").alias("kept_print"), F.col("root").alias(root))
    kept = kept.distinct()

    @F.pandas_udf("long")
    def marked(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts.tolist()], dtype="int64")

    twice = left.join(both, left[doc_id].eqNullSafe(both["gone_id"]), "left_semi")
    twice = twice.withColumn(mark, marked(F.col(text).cast("string")))
    on = twice[doc_id].eqNullSafe(kept["kept_id"]) & (twice[mark] == kept["kept_print"])
    twice = twice.join(kept, on).select(*[twice[c] for c in twice.columns], kept[root])
    document = Window.partitionBy(doc_id, root, F.when(F.col(doc_id).isNotNull(), F.col(text))).orderBy(text)
    twice = twice.withColumn(rank, F.row_number().over(document)).filter(F.col(rank) == 1)
    return plain.unionByName(twice.select(*docs.columns))
