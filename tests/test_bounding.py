"""Contribution bounds against a plain re-computation, and on a table with one hot unit."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hushframe.functions.uniform import hash52
from hushframe.operators import bounding as B


@pytest.fixture(scope="module")
def rows(spark):
    """3000 rows; unit 0 holds a third of them, and one type of it a quarter."""
    unit = F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(60)))
    kind = F.when(F.col("id") % 12 == 0, "a").otherwise(F.substring(F.md5(F.col("id").cast("string")), 1, 1))
    df = spark.range(3000).select("id", unit.alias("unit"), kind.alias("kind"), (F.col("id") % 17).alias("v"))
    return df.withColumns({"row_hash": hash52(5, "id"), "pair_hash": hash52(5, "unit", "kind")})


UNIT = B.PrivacyUnit("unit", partitions=2, rows=3, row_key=("id",), seed=5)


def by_pair(rows):
    pairs = defaultdict(list)
    for r in rows:
        pairs[r["unit"], r["kind"]].append(r)
    return pairs


def expected(rows, partitions, per_pair):
    pairs = by_pair(rows)
    kinds = defaultdict(list)
    for (unit, kind), members in pairs.items():
        kinds[unit].append((members[0]["pair_hash"], kind))
    kept = set()
    for (unit, kind), members in pairs.items():
        if partitions is None or (members[0]["pair_hash"], kind) in sorted(kinds[unit])[:partitions]:
            first = sorted(members, key=lambda r: (r["row_hash"], r["id"]))
            kept |= {r["id"] for r in (first if per_pair is None else first[:per_pair])}
    return kept


def ids(df):
    found = [r["id"] for r in df.select("id").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture(params=[1000, 1], ids=["ranked in task", "sliced"])
def threshold(request, spark, monkeypatch):
    monkeypatch.setattr(B, "SLICE_BITS", 2)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_rows(rows, threshold):
    assert ids(B.bound_rows(rows, UNIT, ["kind"])) == expected(rows.collect(), None, 3)


def test_partitions(rows, threshold):
    assert ids(B.bound_partitions(rows, UNIT, ["kind"])) == expected(rows.collect(), 2, None)


def test_both(rows, threshold):
    assert ids(B.bound_contributions(rows, UNIT, ["kind"])) == expected(rows.collect(), 2, 3)


def test_global_partition(rows):
    kept = B.bound_contributions(rows, UNIT)
    assert kept.groupBy("unit").count().agg(F.max("count")).first()[0] == 3


def test_one_value_each_takes_the_same_rows(rows):
    unit = B.PrivacyUnit("unit", partitions=2, rows=1, row_key=("id",), seed=5)
    slow = B.bound_contributions(rows, unit, ["kind"]).select("unit", "kind", "v", B.RANK)
    fast = B.one_value_each(rows, "v", unit, ["kind"]).select("unit", "kind", "v", B.RANK)
    assert sorted(slow.collect()) == sorted(fast.collect())


def test_keyset_comes_before_the_partition_bound(spark, rows):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "kind string")
    kept = B.bound_contributions(rows, UNIT, ["kind"], keys)
    wanted = [r for r in rows.collect() if r["kind"] in "abc"]
    assert ids(kept) == expected(wanted, 2, 3)
    pairs = B.contributed_partitions(rows, UNIT, ["kind"], keys).collect()
    assert {(r["unit"], r["kind"]) for r in pairs} == {
        (r["unit"], r["kind"]) for r in wanted if r["id"] in expected(wanted, 2, None)
    }


def test_null_partition_is_kept(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 2), (2, "x", 3)], "unit int, kind string, id int")
    unit = B.PrivacyUnit("unit", partitions=1, rows=1, row_key=("id",))
    assert B.bound_contributions(df, unit, ["kind"]).count() == 2
    assert B.bound_partitions(df, unit, ["kind"]).count() == 3


def test_rows_are_cut_before_the_shuffle(rows):
    plan = B.bound_contributions(rows, UNIT, ["kind"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 2 and plan.count("WindowGroupLimit") == 4


def test_bad_bounds():
    with pytest.raises(ValueError):
        B.PrivacyUnit("unit", partitions=0)
