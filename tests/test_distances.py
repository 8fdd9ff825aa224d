"""Worked examples of table distances."""

from __future__ import annotations

import math

import pytest

from hushframe.operators import distances as D


def pairs(spark, a, b, schema):
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


def value(df):
    return df.first()[0]


def test_numbers(spark):
    a, b = pairs(spark, [(20,)], [(82,)], "x int")
    assert value(D.absolute_difference(a, b)) == 62


def test_equal_tables(spark):
    a, b = pairs(spark, [(1,), (1,)], [(1,), (1,)], "a int")
    assert value(D.symmetric_difference(a, b)) == 0


@pytest.fixture()
def tables(spark):
    return pairs(spark, [(1, 2), (3, 2), (1, 2), (2, 4), (3, 3)], [(1, 2), (2, 4), (1, 1)], "a int, b int")


def test_rows(tables):
    assert value(D.symmetric_difference(*tables)) == 4


def test_groups(spark, tables):
    keys = spark.createDataFrame([(1,), (2,), (4,)], "b int")
    row = D.grouped_symmetric_difference(*tables, keys, ["b"]).first()
    assert (row["row_distance"], row["group_distance"]) == (3, 2)


def test_columns(spark):
    schema = "row int, a int, b int"
    a, b = pairs(spark, [(1, 1, 3), (2, 23, 1)], [(1, 2, 1), (2, 20, 8)], schema)
    assert value(D.on_columns(a, b, ["row"], {"a": "sum"})) == 4
    assert value(D.on_columns(a, b, ["row"], {"b": "root_sum_squares"})) == pytest.approx(math.sqrt(53))
    both = D.on_columns(a, b, ["row"], {"a": "sum", "b": "root_sum_squares"}).first()
    assert tuple(both) == pytest.approx((4, math.sqrt(53)))


def test_columns_need_a_unique_key(spark):
    a, b = pairs(spark, [(1, 1), (1, 2)], [(1, 1), (1, 2)], "row int, a int")
    with pytest.raises(Exception, match="row key is not unique"):
        D.on_columns(a, b, ["row"], {"a": "sum"}).collect()


def test_named(spark):
    numbers = pairs(spark, [(1,)], [(10,)], "x int")
    rows = pairs(spark, [(1, 2), (1, 1), (3, 4)], [(2, 1), (1, 1)], "a int, b int")
    both = D.dict_metric({"x": D.absolute_difference(*numbers), "y": D.symmetric_difference(*rows)})
    assert {r["name"]: r["distance"] for r in both.collect()} == {"x": 9, "y": 3}


def test_keys(spark):
    one = pairs(spark, [(1, 1), (1, 1), (2, 1)], [(1, 1), (1, 1), (3, 1)], "a int, b int")
    two = pairs(spark, [(1, "1"), (4, "1")], [(1, "1"), (4, "2")], "c int, d string")
    assert value(D.add_remove_keys({"t1": (*one, "a"), "t2": (*two, "c")})) == 4


def test_a_repeated_row_counts_as_another_key_content(spark):
    a, b = pairs(spark, [(1, 1), (1, 1)], [(1, 1)], "k int, v int")
    assert value(D.add_remove_keys({"t": (a, b, "k")})) == 2


def test_hamming(spark):
    a, b = pairs(spark, [(1, "x"), (2, "y"), (3, None)], [(1, "x"), (2, "z"), (3, None)], "k int, v string")
    assert value(D.hamming(a, b, ["k"])) == 1
    assert value(D.symmetric_difference(a, b)) == 2


def test_grouped(spark, tables):
    assert value(D.if_grouped_by(*tables, "b")) == 4
    assert value(D.if_grouped_by(*tables, "b", "root_sum_squares")) == pytest.approx(math.sqrt(1 + 4 + 1))
    with pytest.raises(ValueError):
        D.if_grouped_by(*tables, "b", "max")


def test_a_value_that_is_missing_on_one_side(spark):
    a = spark.createDataFrame([(1, 5.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 3.0), (2, None)], "k int, v double")
    assert D.on_columns(a, b, ["k"], {"v": "sum"}).first()["v"] == 2.0
    c = spark.createDataFrame([(1, None), (2, None)], "k int, v double")
    with pytest.raises(Exception, match="one side"):
        D.on_columns(a, c, ["k"], {"v": "sum"}).collect()
