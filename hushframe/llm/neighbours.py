"""Nearest neighbours by cosine with vantage-point trees: a small one that deals vectors to shards, and one per shard.

A bounded sample gives the upper tree, whose leaves are the shards; a leaf with more vectors than a shard
holds is cut into parts. Each shard goes to one task, which builds its tree once and lets the queries
that were sent there stream through it. A query first visits the shard it would lie in itself; its
fifth best there bounds how far an answer can be, and the triangle inequality, with the vantage points of
the upper tree, says which other shards cannot hold one. Only the others get a copy of the query, and no vector is copied.

Scores are rounded once, from about a hundred bits, so equal directions have equal scores and ties are true ties.
Pruning uses distances between scaled vectors and a slack above their rounding errors, and every vector that could still
reach the fifth best score stays, however many there are: factor one is exact search. A larger factor prunes more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import importable, share_of
from hushframe.plans.materialise import materialise

#: Vectors of a shard, queries that a task holds at once, and vectors of a leaf of a shard's tree.
SHARD, BLOCK, LEAF = 4096, 2048, 64
#: Components of the sample that the upper trees are fitted on, at most, and how many lengths of vectors have one.
SAMPLE, LENGTHS = 1 << 20, 64
#: Least number of sampled vectors of a shard.
THIN = 8
#: How much the pruning bound is relaxed.
FACTOR = 1.1
EPS = 2.0**-52


@dataclass
class Node:
    """Vectors `inside` lie up to `radius` from the `centre`, the others from there on; a leaf has only members."""

    members: np.ndarray
    centre: np.ndarray | None = None
    radius: float = 0.0
    inside: "Node | None" = None
    outside: "Node | None" = None


def _distance(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """From the difference, which is exact to a few units of the last place however near the vectors are."""
    return np.sqrt(((vectors - centre) ** 2).sum(axis=1))


def _error(dim: int) -> float:
    """Above the rounding error of a product or distance of two computed vectors of length one."""
    return 4 * (dim + 16) * EPS


def _reach(score: np.ndarray, dim: int) -> np.ndarray:
    """Distance beyond which no vector has this cosine, all rounding allowed for."""
    far = np.sqrt(np.maximum(0.0, 2 - 2 * (np.maximum(score, -1.0) - 2 * _error(dim)))) + _error(dim)
    return np.where(np.isneginf(score), np.inf, far)


def build(vectors: np.ndarray, leaf: int = LEAF) -> Node:
    """The tree over rows of length one. The farthest row from a node's first one is its vantage point."""

    def grow(members: np.ndarray) -> Node:
        if len(members) <= leaf:
            return Node(members)
        own = vectors[members]
        centre = own[np.argmax(_distance(own, own[0]))]
        away = _distance(own, centre)
        radius = float(np.median(away))
        near = away <= radius
        if near.all() or not near.any():
            return Node(members)
        return Node(members[:0], centre, radius, grow(members[near]), grow(members[~near]))

    return grow(np.arange(len(vectors)))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row divided by the power of two just above its largest component, so that no sum of squares
    overflows or vanishes. The division is exact, so directions and cosines stay what they are."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    rows = scaled(vectors)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


# Pairs of doubles (high, low) with the low one below the high one's last place: error-free sums and products.


def _two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _two_product(a, b):
    def halves(x):
        c = 134217729.0 * x  # 2^27 + 1
        high = c - (c - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _dot(a: np.ndarray, b: np.ndarray):
    high, low = np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        p, e = _two_product(a[:, j], b[:, j])
        high, t = _two_sum(high, p)
        low = low + (e + t)
    return _two_sum(high, low)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of `a` with that of `b` (rows as `scaled` gives them), computed twice as precisely and rounded."""
    (xh, xl), (yh, yl), (dh, dl) = _dot(a, a), _dot(b, b), _dot(a, b)
    ph, pl = _two_product(xh, yh)
    ph, pl = _two_sum(ph, pl + (xh * yl + xl * yh))
    root = np.sqrt(ph)
    sh, sl = _two_product(root, root)
    root, rest = _two_sum(root, ((ph - sh) - sl + pl) / (2 * root))
    q = dh / root
    th, tl = _two_product(q, root)
    return q + ((dh - th) - tl + dl - q * rest) / root


class Search:
    """All rows of one tree that may be among the best `keep` of each query, ties included."""

    def __init__(self, vectors: np.ndarray, queries: np.ndarray, keep: int, factor: float, least: np.ndarray) -> None:
        self.vectors, self.queries, self.factor = vectors, queries, factor
        self.error = _error(vectors.shape[1])
        self.top = np.full((len(queries), keep), -np.inf)
        self.least = least.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def visit(self, node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.inside is None or node.outside is None:
            score = self.queries[at] @ self.vectors[node.members].T
            keep = self.top.shape[1]
            both = np.concatenate([self.top[at], score], axis=1)
            self.top[at] = -np.partition(-both, keep - 1, axis=1)[:, :keep]
            self.least[at] = np.maximum(self.least[at], self.top[at].min(axis=1))
            query, row = np.nonzero(score >= self.least[at][:, None] - 2 * self.error)
            self.found.append((at[query], node.members[row], score[query, row]))
            return
        away = _distance(self.queries[at], node.centre)
        near = away <= node.radius
        self.visit(node.inside, at[near])
        self.visit(node.outside, at[~near])
        cross = (np.abs(away - node.radius) - 2 * self.error) * self.factor <= _reach(self.least[at], self.vectors.shape[1])
        self.visit(node.outside, at[near & cross])
        self.visit(node.inside, at[~near & cross])

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        query, row, score = (np.concatenate(x) for x in zip(*self.found))
        stay = score >= self.least[query] - 2 * self.error
        return query[stay], row[stay]


class Shard:
    """One shard's vectors as distinct points, each with its smallest ids, and their tree.

    Rows that are equal but for a power of two are one point.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, count: int, factor: float) -> None:
        self.count, self.factor = count, factor
        self.points, which = np.unique(scaled(vectors), axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        self.ids = ids[order]
        self.first = np.searchsorted(which.ravel()[order], np.arange(len(self.points) + 1))
        self.unit = unit(self.points)
        self.tree = build(self.unit)

    def search(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, cosine) of the best `count` rows for each query that score `least` or more, its own id left out."""
        count = self.count
        search = Search(self.unit, unit(queries), count + 1, self.factor, least)
        search.visit(self.tree, np.arange(len(ids)))
        query, point = search.candidates()
        asked, score = scaled(queries), np.empty(len(query))
        for begin in range(0, len(query), 1 << 14):
            part = slice(begin, begin + (1 << 14))
            score[part] = cosines(self.points[point[part]], asked[query[part]])
        # of the ids of a point no more than count + 1 can be answers, one of which may be the query's own
        several = np.minimum(self.first[point + 1] - self.first[point], count + 1)
        turn = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
        named = self.ids[np.repeat(self.first[point], several) + turn]
        query, score = np.repeat(query, several), np.repeat(score, several)
        other = named != ids[query]
        query, named, score = query[other], named[other], score[other]
        order = np.lexsort((named, -score, query))
        query, named, score = query[order], named[order], score[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < count
        return ids[query[best]], named[best], score[best]


@dataclass
class Dealer:
    """The upper tree of vectors of one length. Leaf number and lower bounds come from the same walk."""

    root: Node
    leaves: int = 0
    numbers: dict[int, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, vectors: np.ndarray, leaf: int) -> Dealer:
        dealer = cls(build(unit(vectors), leaf))

        def number(node: Node) -> None:
            node.members = node.members[:0]
            if node.inside is None or node.outside is None:
                node.radius = float(dealer.leaves)  # a leaf's radius is its number
                dealer.leaves += 1
                return
            number(node.inside)
            number(node.outside)

        number(dealer.root)
        return dealer

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        rows, out = unit(vectors), np.zeros(len(vectors), np.int64)

        def walk(node: Node, at: np.ndarray) -> None:
            if not len(at):
                return
            if node.centre is None:
                out[at] = int(node.radius)
                return
            near = _distance(rows[at], node.centre) <= node.radius
            walk(node.inside, at[near])
            walk(node.outside, at[~near])

        walk(self.root, np.arange(len(rows)))
        return out

    def reached(self, vectors: np.ndarray, least: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that may hold a vector whose cosine with the row is `least` or more."""
        rows, reach = unit(vectors), _reach(least, vectors.shape[1])
        found: list[tuple[np.ndarray, int]] = []
        error = _error(vectors.shape[1])

        def walk(node: Node, at: np.ndarray) -> None:
            if not len(at):
                return
            if node.centre is None:
                found.append((at, int(node.radius)))
                return
            beyond = _distance(rows[at], node.centre) - node.radius
            walk(node.inside, at[(beyond - 2 * error) * factor <= reach[at]])
            walk(node.outside, at[(-beyond - 2 * error) * factor <= reach[at]])

        walk(self.root, np.arange(len(rows)))
        return np.concatenate([a for a, _ in found]), np.concatenate([np.full(len(a), n) for a, n in found])


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy())


def _dealers(held: DataFrame, shard: int) -> tuple[dict[int, Dealer], int]:
    """Upper trees for the most frequent lengths, fitted on a sample by hash, and the largest count of any other length."""
    counts = held.groupBy("size").count().orderBy(F.desc("count"), "size").limit(LENGTHS + 1).collect()
    dealers = {}
    for row in counts[:LENGTHS]:
        room = SAMPLE // min(len(counts), LENGTHS) // row["size"]
        if row["count"] <= shard or room < 2 * THIN:
            continue
        key = F.xxhash64("id", "v")
        own = held.filter(F.col("size") == row["size"])
        if row["count"] > room:
            own = own.filter(share_of(key, 1.1 * room / row["count"]))
        sample = own.orderBy(key, "id").select("v").limit(room).toPandas()
        if len(sample):
            dealers[row["size"]] = Dealer.fit(_stacked(sample["v"]), max(THIN, len(sample) * shard // row["count"]))
    return dealers, max([r["count"] for r in counts if r["size"] not in dealers], default=0)


def _search_shards(placed: DataFrame, asked: DataFrame, count: int, factor: float, block: int) -> DataFrame:
    """Each shard's vectors and then its queries, in one task: (query_id, vec_id, score)."""
    vectors = placed.select("size", "leaf", "part", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("least"))
    queries = asked.select("size", "leaf", "part", F.lit(1).alias("kind"), "id", "v", "least")
    place = ["size", "leaf", "part"]
    dealt = vectors.unionByName(queries).repartition(*place).sortWithinPartitions(*place, "kind", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ids, rows, tree = None, [], [], None
        for batch in batches:
            for key, group in batch.groupby([*place, "kind"], sort=True):
                if key[:3] != current:
                    current, ids, rows, tree = key[:3], [], [], None
                if key[3] == 0:
                    ids.append(group["id"].to_numpy(np.int64))
                    rows.append(_stacked(group["v"]))
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree = Shard(np.concatenate(ids), np.concatenate(rows), count, factor)
                for begin in range(0, len(group), block):
                    part = group.iloc[begin : begin + block]
                    least = part["least"].fillna(-np.inf).to_numpy(float)
                    found = tree.search(part["id"].to_numpy(np.int64), _stacked(part["v"]), least)
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    return dealt.mapInPandas(run, "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, count: int = 5, factor: float = FACTOR,
    vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine in double precision) for each query.

    Vectors that are null, zero, empty or hold a null or non-finite component, and rows with a null id,
    take no part, neither do vectors of another length than the query's. Equal scores are ordered by
    vec_id, and no tie is lost. A query's own id is no answer to it. Repeated candidate rows are answers each; repeated
    queries (by id) are answered once, with the smallest of their vectors, compared element by element.
    Fewer candidates: fewer rows. Of equal vectors only the smallest `count + 1` ids travel, as no other can be an answer.
    """
    importable(vectors.sparkSession)

    def usable(rows: DataFrame) -> DataFrame:
        cleaned = rows.select(
            F.col(vec_id).cast("long").alias("id"), F.transform(embedding, lambda x: x.cast("double")).alias("v")
        ).filter("id is not null and size(v) > 0")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return cleaned.filter(F.coalesce(finite, F.lit(False))).filter(F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))

    turn = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    held = materialise(usable(vectors).withColumn("turn", turn).filter(F.col("turn") <= count + 1).drop("turn"), "vectors")
    first = usable(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    dealers, other = _dealers(held, shard)

    @F.pandas_udf("int")
    def leaf_of(size: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(size), np.int64)
        for length, dealer in dealers.items():
            own = size.to_numpy() == length
            if own.any():
                out[own] = dealer.leaf_of(_stacked(v[own]))
        return pd.Series(out)

    placed = materialise(held.withColumn("leaf", leaf_of("size", "v")), "vectors-placed")
    counted = placed.filter(F.col("size").isin(*dealers)) if dealers else placed.limit(0)
    parts = {(r["size"], r["leaf"]): -(-r["count"] // shard) for r in counted.groupBy("size", "leaf").count().collect()}
    rest = max(1, -(-other // shard))

    @F.pandas_udf("int")
    def parts_of(size: pd.Series, leaf: pd.Series) -> pd.Series:
        return pd.Series([parts.get(key, 1 if key[0] in dealers else rest) for key in zip(size, leaf)])

    def part_of(key: Column) -> Column:
        return F.pmod(key, parts_of("size", "leaf")).cast("int")

    shards = placed.withColumn("part", part_of(F.xxhash64("id", "v")))
    home = first.withColumn("leaf", leaf_of("size", "v")).withColumn("part", part_of(F.xxhash64("id")))
    asked = materialise(home.withColumn("least", F.lit(None).cast("double")), "vector-queries")
    near = materialise(_search_shards(shards, asked, count, factor, block), "vectors-near")

    enough = near.groupBy(F.col("query_id").alias("of")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    bounded = asked.drop("least").join(enough.filter(F.col("n") >= count).drop("n"), F.col("id") == F.col("of"), "left").drop("of")

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, group in batch.groupby("size"):
                for begin in range(0, len(group), block):
                    rows = group.iloc[begin : begin + block].reset_index(drop=True)
                    if length in dealers:
                        least = rows["least"].fillna(-np.inf).to_numpy(float)
                        row, leaf = dealers[length].reached(_stacked(rows["v"]), least, factor)
                    else:
                        row, leaf = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                    several = np.array([parts.get((length, n), 0 if length in dealers else rest) for n in leaf.tolist()], np.int64)
                    part = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
                    row, leaf = np.repeat(row, several), np.repeat(leaf, several)
                    new = (leaf != rows["leaf"].to_numpy()[row]) | (part != rows["part"].to_numpy()[row])
                    for at in range(0, int(new.sum()), 1 << 13):
                        some = np.flatnonzero(new)[at : at + (1 << 13)]
                        sent = rows.iloc[row[some]]
                        yield pd.DataFrame(
                            {"size": sent["size"].to_numpy(), "leaf": leaf[some], "part": part[some],
                             "id": sent["id"].to_numpy(), "v": sent["v"].to_numpy(), "least": sent["least"].to_numpy()}
                        )

    sent = bounded.select("size", "leaf", "part", "id", "v", "least").mapInPandas(
        elsewhere, "size int, leaf int, part int, id long, v array<double>, least double"
    )
    found = near.unionByName(_search_shards(shards, sent, count, factor, block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")
