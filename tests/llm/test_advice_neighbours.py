"""Vectors with components whose squares overflow or vanish, and queries that share an id."""

from __future__ import annotations

import math

import pytest

from hushframe.llm import neighbours


def test_extreme_components(spark):
    sizes = [1e200, 1e-200, 1.7e308, 5e-324, 1.0, 3e-310]
    rows = [(i, [math.cos(0.1 * i) * s, math.sin(0.1 * i) * s]) for i, s in enumerate(sizes) if s != 5e-324]
    rows.append((3, [5e-324, 5e-324]))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(table, table, factor=1.0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    angle = {i: math.pi / 4 if i == 3 else 0.1 * i for i in range(6)}
    for i in range(6):
        assert got[i] == pytest.approx({j: math.cos(angle[i] - angle[j]) for j in range(6) if j != i}, abs=1e-9)


def test_smallest_vector_of_a_repeated_query_counts(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.1]), (9, [0.1, 1.0]), (9, [0.2, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, asked.coalesce(1), factor=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 1] and got[1].score == pytest.approx(0.1 / math.hypot(0.1, 1))
