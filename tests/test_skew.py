"""Joins on a key that holds most of the rows are split by the adaptive plan, and stay right."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hushframe.functions.uniform import hash52
from hushframe.operators import bounding as B
from hushframe.operators.bounding import PrivacyUnit, bound_contributions, bound_rows
from hushframe.operators import distances as D
from hushframe.operators import keysets as K
from hushframe.plans import ledger as L

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "32",
}
ROWS = 200_000


@pytest.fixture(scope="module", autouse=True)
def small_tasks(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def rows(spark):
    """Key 0 holds half of the rows."""
    key = F.when(F.col("id") % 2 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)) + 1)
    return spark.range(0, ROWS, 1, 16).select("id", key.alias("k"), F.lit("t").alias("kind"), (F.col("id") * 1.0).alias("w"))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def split_and_count(df):
    plan = final_plan(df)
    assert "SortMergeJoin(skew=true)" in plan
    return df.count()


def test_public_join(spark, rows):
    public = spark.range(5001).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("name"))
    assert split_and_count(K.join_public(rows, public, ["k"])) == ROWS


def test_restriction_to_keys(spark, rows):
    keys = spark.range(2501).select(F.col("id").alias("k"))
    assert split_and_count(K.restrict_to_keys(rows, keys, ["k"])) == rows.filter("k <= 2500").count()


def test_partition_bound(rows):
    unit = B.PrivacyUnit("k", partitions=1)
    assert split_and_count(B.bound_partitions(rows, unit, ["kind"])) == ROWS


def test_removed_keys(spark, rows):
    gone = spark.range(1, 2501).select(F.col("id").alias("k"))
    assert split_and_count(D.remove_keys(rows, gone, "k")) == rows.filter("k = 0 or k > 2500").count()


def test_budget_split(rows):
    plan = rows.select(F.col("k").cast("string").alias("session"), (F.col("w") + 1).alias("weight"))
    shares = L.split_budget(plan, 1.0)
    assert split_and_count(shares) == ROWS
    off = shares.groupBy("session").agg(F.abs(F.sum("epsilon") - 1).alias("off"))
    assert off.agg(F.max("off")).first()[0] < 1e-9


def test_a_busy_unit_above_the_limit_of_spark(spark):
    """k = 2000: the rows kept of a unit that holds most rows lie in many tasks, and are those of one window."""
    df = spark.range(60_000).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id")).alias("u"), "id")
    unit = PrivacyUnit("u", rows=2000, row_key=("id",))
    kept = bound_rows(df, unit)
    hot = kept.filter("u = 0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else tiny partitions are put together
    try:
        tasks = [r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 2000 and max(tasks) < 1000
    order = Window.partitionBy("u").orderBy(hash52(unit.seed, "id"), "id")
    plain = df.withColumn("r", F.row_number().over(order)).filter("r <= 2000").select("u", "id")
    assert kept.exceptAll(plain).isEmpty() and kept.count() == plain.count()
    many = PrivacyUnit("u", partitions=1500, rows=2, row_key=("id",))
    grouped = df.withColumn("g", F.col("id") % 4000)
    both = bound_contributions(grouped, many, ["g"]).filter("u = 0")
    assert both.select("g").distinct().count() == 1500


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "u int, v int")
    assert [r["u"] for r in bound_rows(df, PrivacyUnit("u")).collect()] == [5]
    with pytest.raises(Exception, match="has no u"):
        bound_rows(df, PrivacyUnit("u", missing="refuse")).collect()
