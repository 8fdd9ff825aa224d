"""Scores that tie or nearly tie: factor one must equal brute force in id, rank and score, whatever the shards."""

from __future__ import annotations

from fractions import Fraction
from math import isqrt

import numpy as np
import pytest

from hushframe.llm import neighbours


def exact_cosine(a, b) -> float:
    """The cosine by whole numbers, rounded once."""
    a, b = ([Fraction(float(x)) for x in v] for v in (a, b))
    dot = sum(x * y for x, y in zip(a, b))
    square = dot * dot / (sum(x * x for x in a) * sum(y * y for y in b))
    shift = 1 << 400
    root = isqrt(int(square * shift))
    return float(Fraction(root, isqrt(shift))) * (1 if dot >= 0 else -1)


def brute(rows, asked, count=5):
    out = {}
    for query, q in asked:
        scores = sorted((-exact_cosine(q, v), i) for i, v in rows if i != query)
        out[query] = [(i, -s) for s, i in scores[:count]]
    return out


def found(spark, rows, asked, **options):
    schema = "vec_id long, embedding array<double>"
    answer = neighbours.nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), factor=1.0, **options)
    out = {}
    for r in answer.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def one_hot():
    return [(i, [float(i == j) for j in range(60)]) for i in range(60)]


def small_integers():
    draw = np.random.default_rng(5)
    vectors = draw.integers(-1, 2, (150, 4)).astype(float)
    return [(i, v.tolist()) for i, v in enumerate(vectors) if v.any()]


def collinear():
    return [(i, [float(k), 2.0 * k, -3.0 * k]) for i, k in enumerate(range(59, 0, -1))]


def near_equal():
    draw = np.random.default_rng(6)
    centre = draw.normal(size=8)
    return [(i, (centre + 1e-8 * draw.normal(size=8)).tolist()) for i in range(120)]


@pytest.mark.parametrize("make", [one_hot, small_integers, collinear, near_equal])
@pytest.mark.parametrize("shard", [neighbours.SHARD, 24])
def test_ties_are_whole(spark, make, shard):
    rows = make()
    asked = rows[::20]
    assert found(spark, rows, asked, shard=shard) == brute(rows, asked)


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000, [1.0, 2.1])]
    got = found(spark, rows, [rows[0], rows[150], rows[-1]], shard=16)
    assert {q: [i for i, _ in a] for q, a in got.items()} == {0: [1, 2, 3, 4, 5], 150: [0, 1, 2, 3, 4], 1000: [0, 1, 2, 3, 4]}
