"""Contribution bounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import scalars
from hushframe.operators import bounding as B
from hushframe.operators.private import dp_aggregate, dp_count
from workload.registry import register, table
from workload.sql import NOISE, SEED, clamp, d, geometric, h52, laplace

USER = B.PrivacyUnit("user_id", partitions=2, rows=3, row_key=("event_id",), seed=SEED, algorithm="md5")

# Rows of at most 2 event types per user, by hash of (user, type).
BOUNDED_TYPES = f"""
p as (select user_id, event_type, row_number() over (partition by user_id
        order by {h52(SEED, 'user_id', 'event_type')}, event_type) as pn
      from (select distinct user_id, event_type from events))"""

# At most 3 events per user and type, of at most 2 types per user.
BOUNDED_EVENTS = f"""{BOUNDED_TYPES},
r as (select *, row_number() over (partition by user_id, event_type
        order by {h52(SEED, 'event_id')}, event_id) as rn from events),
bounded as (select r.* from r join p using (user_id, event_type) where pn <= 2 and rn <= 3)"""


@register(f"with {BOUNDED_TYPES} select e.* exclude (ts, props) from events e join p using (user_id, event_type) where pn <= 2")
def bound_partitions(spark, folder):
    return B.bound_partitions(table(spark, folder, "events").drop("ts", "props"), USER, ["event_type"])


@register(f"""
with r as (select *, row_number() over (partition by user_id, event_type
             order by {h52(SEED, 'event_id')}, event_id) as rn from events)
select event_id, user_id, event_type, value from r where rn <= 3
""")
def bound_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return B.bound_rows(events, USER, ["event_type"])


@register(f"with {BOUNDED_EVENTS} select event_id, user_id, event_type, value from bounded")
def bound_contributions(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return B.bound_contributions(events, USER, ["event_type"]).drop(B.RANK)


@register(f"select event_id, {clamp('value', 20, 300)} as value from events")
def bound_values(spark, folder):
    return table(spark, folder, "events").select("event_id", scalars.clamp("value", 20, 300).alias("value"))


@register(f"""
with r as (select *, row_number() over (partition by o_custkey
             order by {h52(SEED, 'o_orderkey')}, o_orderkey) as rn from orders)
select o_custkey, o_orderkey, o_totalprice from r where rn <= 4
""")
def truncate_rows_per_key(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return B.truncate_rows(orders, ["o_custkey"], 4, ["o_orderkey"], SEED, "md5")


@register(f"""
with p as (select o_custkey, o_orderpriority, row_number() over (partition by o_custkey
             order by {h52(SEED, 'o_custkey', 'o_orderpriority')}, o_orderpriority) as rn
           from (select distinct o_custkey, o_orderpriority from orders))
select o.o_custkey, o.o_orderkey, o.o_orderpriority from orders o join p using (o_custkey, o_orderpriority) where rn <= 2
""")
def truncate_groups_per_key(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return B.truncate_groups(orders, ["o_custkey"], ["o_orderpriority"], 2, SEED, "md5")


@register(f"""
with r as (select *, row_number() over (partition by o_custkey, o_orderpriority
             order by {h52(SEED, 'o_orderkey')}, o_orderkey) as rn from orders)
select o_custkey, o_orderpriority, o_orderkey from r where rn <= 1
""")
def truncate_rows_per_key_and_group(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return B.truncate_rows(orders, ["o_custkey", "o_orderpriority"], 1, ["o_orderkey"], SEED, "md5")


@register(f"select count(*) + {geometric('count_rows', d(7.0))} as \"count\" from lineitem")
def count_with_row_influence(spark, folder):
    """One person has at most 7 lines of an order."""
    return dp_count(table(spark, folder, "lineitem"), 1.0, NOISE, unit=B.PrivacyUnit(rows=7))


@register(f"""
with w as (select event_id, user_id, cast(date_part('hour', ts) as int) as hour, value * 2 as amount from events),
p as (select user_id, hour, row_number() over (partition by user_id
        order by {h52(SEED, 'user_id', 'hour')}, hour) as pn from (select distinct user_id, hour from w)),
r as (select *, row_number() over (partition by user_id, hour order by {h52(SEED, 'event_id')}, event_id) as rn from w),
b as (select r.hour, {clamp('amount', 0, 400)} as x from r join p using (user_id, hour) where pn <= 2 and rn <= 3),
k as (select unnest(range(24))::int as hour),
m as (select k.hour, count(x) as n, coalesce(sum(x), 0) as s from k left join b using (hour) group by 1)
select hour, n + {geometric('count_rows', d(12.0), 'hour')} as "count",
       round(s + {laplace('sum_sum', d(4800.0), 'hour')}, 6) as "sum" from m
""")
def extract_by_expression(spark, folder):
    """Unit, partition and value are expressions over the columns, not row functions."""
    events = table(spark, folder, "events").select("event_id", "user_id", F.hour("ts").alias("hour"), "value")
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    answer = dp_aggregate(
        events, ["count", "sum"], 1.0, NOISE, value=F.col("value") * 2, low=0, high=400,
        by=["hour"], keyset=hours, unit=USER,
    )
    return answer.withColumn("sum", F.round("sum", 6))
