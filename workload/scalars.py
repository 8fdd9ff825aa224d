"""Filters, projections, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import scalars as S
from hushframe.operators.ids import with_unique_id
from hushframe.operators.private import dp_group_count
from hushframe.operators.resize import hash_sample, resize
from workload.registry import register, table
from workload.sql import NOISE, SEED, clamp, d, geometric, h52


@register("""
select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem
where l_quantity >= 18 and l_returnflag in ('A', 'R')
""")
def filter_rows(spark, folder):
    rows = table(spark, folder, "lineitem").filter("l_quantity >= 18 AND l_returnflag IN ('A', 'R')")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@register("select c_custkey as id, c_mktsegment as segment, c_acctbal as balance from customer")
def select_and_rename(spark, folder):
    names = {"c_custkey": "id", "c_mktsegment": "segment", "c_acctbal": "balance"}
    return table(spark, folder, "customer").select(*names).withColumnsRenamed(names)


@register(f"""
with v as (select event_id, case when event_type = 'error' then null
                                 when value > 400 then 'nan'::double else value end as x from events)
select event_id, {clamp('x', 10, 200)} as clamped from v
""")
def clamp_values(spark, folder):
    x = F.when(F.col("event_type") == "error", None).when(F.col("value") > 400, F.lit(float("nan")))
    rows = table(spark, folder, "events").select("event_id", x.otherwise(F.col("value")).alias("x"))
    return rows.select("event_id", S.clamp("x", 10, 200).alias("clamped"))


@register("""
select event_id, coalesce(try_cast(substr(props, 7, 2) as double), -1.0::double) as number from events
""")
def cast_or_default(spark, folder):
    text = F.substring("props", 7, 2)
    rows = table(spark, folder, "events")
    return rows.select("event_id", S.cast_or_default(text, "double", -1.0).alias("number"))


_COUNT_ORDERS = "(select count(*) from orders)"


@register(f"""
with r as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, row_number() over (
             order by {h52(SEED, 'l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity')},
                      l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) as rn from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from r where rn <= {_COUNT_ORDERS} * 3
""")
def sample_to_size(spark, folder):
    n = 3 * table(spark, folder, "orders").count()
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    return hash_sample(table(spark, folder, "lineitem").select(*columns), n, SEED, "md5")


@register(f"""
with r as (select l_returnflag, l_quantity, row_number() over (
             order by {h52(SEED, 'l_returnflag', 'l_quantity')}, l_returnflag, l_quantity) as rn from lineitem),
kept as (select l_returnflag, {clamp('l_quantity', 5, 40)} as l_quantity from r where rn <= {_COUNT_ORDERS} * 3)
select l_returnflag, l_quantity, count(*) as n from kept group by all
""")
def sample_many_equal_rows(spark, folder):
    n = 3 * table(spark, folder, "orders").count()
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity")
    sized = resize(rows, "l_quantity", n, 5.0, 5.0, 40.0, SEED, "md5")
    return sized.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))


@register(f"""
with kept as (select event_id, {clamp('value', 5, 250)} as value from events
              union all
              select null, 5.0 from range((select 2 * count(*) from orders) - (select count(*) from events)))
select event_id, value from kept
""")
def pad_to_size(spark, folder):
    n = 2 * table(spark, folder, "orders").count()
    rows = table(spark, folder, "events").select("event_id", "value")
    return resize(rows, "value", n, 5.0, 5.0, 250.0, SEED, "md5")


_WITH_MISSING = """select event_id, case when event_type = 'error' then null
                 when value > 400 then 'nan'::double else value end as x from events"""


def _with_missing(spark, folder):
    x = F.when(F.col("event_type") == "error", None).when(F.col("value") > 400, F.lit(float("nan")))
    return table(spark, folder, "events").select("event_id", x.otherwise(F.col("value")).alias("x"))


@register(f"with v as ({_WITH_MISSING}) select event_id, x from v where x is not null and not isnan(x)")
def drop_missing(spark, folder):
    return S.drop_missing(_with_missing(spark, folder), ["x"])


@register(f"""with v as ({_WITH_MISSING})
select event_id, case when x is null or isnan(x) then 1.5::double else x end as x from v""")
def fill_missing(spark, folder):
    return S.fill_missing(_with_missing(spark, folder), {"x": 1.5})


@register(f"""
with c as (select n_nationkey as c_nationkey, count(c_custkey) as n
           from nation left join customer on c_nationkey = n_nationkey group by 1),
noisy as (select c_nationkey, n + {geometric('count_rows', d(2.0), 'c_nationkey')} as "count" from c)
select c_nationkey, "count", case when "count" < 60 then 'true' else 'false' end as under_threshold from noisy
""")
def label_released_counts(spark, folder):
    keys = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    counts = dp_group_count(table(spark, folder, "customer"), keys, ["c_nationkey"], 0.5, NOISE)
    return counts.withColumn("under_threshold", S.label("count < 60", "true", "false"))


@register("""
select l_orderkey, l_linenumber, l_partkey, round_even(l_quantity * 0.125::double, 2) as rounded from lineitem
""")
def round_half_even(spark, folder):
    rounded = S.half_even(F.col("l_quantity") * F.lit(0.125), 2)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rounded.alias("rounded"))


@register(f"""
with t as (select o_custkey, count(*) as n, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as truth
           from orders group by 1),
a as (select o_custkey, n, truth, truth + {geometric('answer', d(4.0), 'o_custkey')} as answer from t)
select o_custkey, n, truth, answer, abs(truth - answer) as error,
       round(case when truth <> 0 then abs(truth - answer)::double / abs(truth)::double end, 9) as relative_error,
       round(abs(truth - answer)::double / n::double, 9) as scaled_error from a
""")
def error_columns(spark, folder):
    finished = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    truth = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), finished.alias("truth")
    )
    answer = F.col("truth") + NOISE.noise("geometric", "answer", F.lit(4.0), ["o_custkey"])
    rows = truth.withColumn("answer", answer).withColumns(S.error_columns("truth", "answer", "n"))
    rounded = {c: F.round(c, 9) for c in ("relative_error", "scaled_error")}
    return rows.withColumns(rounded)


@register("""
select user_id, event_type,
       md5('{"user_id":' || user_id || ',"event_type":"' || event_type || '"}') || '-'
         || row_number() over (partition by user_id, event_type) as id from events
""")
def unique_row_ids(spark, folder):
    return with_unique_id(table(spark, folder, "events").select("user_id", "event_type"))


@register("""
select o_orderpriority, sum(case when o_totalprice >= 300000 then 1 else 0 end)::bigint as hits, count(*) as n
from orders group by 1
""")
def predicate_as_flag(spark, folder):
    rows = table(spark, folder, "orders").withColumn("hit", S.flag("o_totalprice >= 300000"))
    return rows.groupBy("o_orderpriority").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
