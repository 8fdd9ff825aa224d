"""Distances between a table and a neighbour of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import distances as D
from hushframe.operators.keysets import declared_keys
from workload.registry import register, table

COLUMNS = ["event_id", "user_id", "event_type", "value"]

# The neighbour: user 7 is gone, and the purchases of user 9 cost 1 more.
NEIGHBOUR = """
e as (select event_id, user_id, event_type, value from events),
f as (select event_id, user_id, event_type,
             case when user_id = 9 and event_type = 'purchase' then value + 1 else value end as value
      from e where user_id <> 7)"""


def _net(columns: str, left: str = "e", right: str = "f") -> str:
    return f"""net as (select {columns}, sum(a) as na, sum(b) as nb from (
      select {columns}, 1 as a, 0 as b from {left} union all select {columns}, 0 as a, 1 as b from {right})
      group by {columns})"""


def _pair(spark, folder):
    e = table(spark, folder, "events").select(*COLUMNS)
    raised = F.when((F.col("user_id") == 9) & (F.col("event_type") == "purchase"), F.col("value") + 1)
    f = e.filter("user_id <> 7").withColumn("value", raised.otherwise(F.col("value")))
    return e, f


@register(f"with {NEIGHBOUR} select abs((select count(*) from e) - (select count(*) from f)) as distance")
def absolute_difference(spark, folder):
    e, f = [t.agg(F.count("*").alias("n")) for t in _pair(spark, folder)]
    return D.absolute_difference(e, f)


@register(f"with {NEIGHBOUR}, {_net('user_id, event_type, value')} select sum(abs(na - nb))::bigint as distance from net")
def symmetric_difference(spark, folder):
    e, f = [t.drop("event_id") for t in _pair(spark, folder)]
    return D.symmetric_difference(e, f)


@register(f"""
with {NEIGHBOUR}, {_net('user_id, event_type, value')},
g as (select event_type, sum(abs(na - nb)) as r from net where event_type in ('click', 'purchase', 'other') group by 1)
select sum(r)::bigint as row_distance, count(case when r > 0 then 1 end) as group_distance from g
""")
def grouped_symmetric_difference(spark, folder):
    e, f = [t.drop("event_id") for t in _pair(spark, folder)]
    keys = declared_keys(spark, {"event_type": ["click", "purchase", "other"]})
    return D.grouped_symmetric_difference(e, f, keys, ["event_type"])


@register(f"""
with {NEIGHBOUR}
select count(*) as distance from e full join f using (event_id)
where e.user_id is distinct from f.user_id or e.event_type is distinct from f.event_type
   or e.value is distinct from f.value
""")
def hamming(spark, folder):
    return D.hamming(*_pair(spark, folder), ["event_id"])


_SHIFTED = """
o as (select o_orderkey, o_totalprice, o_custkey from orders),
p as (select o_orderkey, o_totalprice + case when o_orderstatus = 'F' then 2.5 else 0 end as o_totalprice,
             o_custkey + case when o_orderstatus = 'O' then 3 else 0 end as o_custkey from orders)"""


def _orders(spark, folder):
    o = table(spark, folder, "orders")
    price = F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "F", 2.5).otherwise(0)
    customer = F.col("o_custkey") + F.when(F.col("o_orderstatus") == "O", 3).otherwise(0)
    columns = ["o_orderkey", "o_totalprice", "o_custkey"]
    return o.select(*columns), o.withColumns({"o_totalprice": price, "o_custkey": customer}).select(*columns)


@register(f"""with {_SHIFTED}
select round(sum(abs(o.o_totalprice - p.o_totalprice)), 4) as o_totalprice from o join p using (o_orderkey)""")
def distance_on_column_sum(spark, folder):
    answer = D.on_columns(*_orders(spark, folder), ["o_orderkey"], {"o_totalprice": "sum"})
    return answer.withColumn("o_totalprice", F.round("o_totalprice", 4))


@register(f"""with {_SHIFTED}
select round(sqrt(sum((o.o_custkey - p.o_custkey)::double ^ 2)), 6) as o_custkey from o join p using (o_orderkey)""")
def distance_on_column_root(spark, folder):
    answer = D.on_columns(*_orders(spark, folder), ["o_orderkey"], {"o_custkey": "root_sum_squares"})
    return answer.withColumn("o_custkey", F.round("o_custkey", 6))


@register(f"""with {_SHIFTED}
select sum(abs(o.o_custkey - p.o_custkey))::bigint as o_custkey,
       round(sqrt(sum((o.o_totalprice - p.o_totalprice) ^ 2)), 6) as o_totalprice from o join p using (o_orderkey)""")
def distance_on_columns(spark, folder):
    metrics = {"o_custkey": "sum", "o_totalprice": "root_sum_squares"}
    answer = D.on_columns(*_orders(spark, folder), ["o_orderkey"], metrics)
    return answer.withColumn("o_totalprice", F.round("o_totalprice", 6))


@register(f"""
with {NEIGHBOUR}, {_net('user_id, event_type, value')}
select 'events' as name, sum(abs(na - nb))::double as distance from net
union all select 'size', abs((select count(*) from e) - (select count(*) from f))::double
""")
def dict_metric(spark, folder):
    e, f = [t.drop("event_id") for t in _pair(spark, folder)]
    sizes = [t.agg(F.count("*").alias("n")) for t in (e, f)]
    return D.dict_metric({"events": D.symmetric_difference(e, f), "size": D.absolute_difference(*sizes)})


# Customers of two tables: the neighbour lacks nation 3, and has other order statuses for some customers.
_TABLES = """
c1 as (select c_custkey as k, c_mktsegment as v from customer),
c2 as (select c_custkey as k, c_mktsegment as v from customer where c_nationkey <> 3),
o1 as (select o_custkey as k, o_orderstatus as v from orders),
o2 as (select o_custkey as k, case when o_totalprice > 450000 then 'X' else o_orderstatus end as v from orders)"""


def _customer_tables(spark, folder):
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    status = F.when(F.col("o_totalprice") > 450000, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    return {
        "customer": (
            c.select("c_custkey", "c_mktsegment"),
            c.filter("c_nationkey <> 3").select("c_custkey", "c_mktsegment"),
            "c_custkey",
        ),
        "orders": (o.select("o_custkey", "o_orderstatus"), o.select("o_custkey", status), "o_custkey"),
    }


def _keys_sql(pairs: list[tuple[str, str]]) -> str:
    parts = " union all ".join(
        f"""select k, max(na > 0) as ia, max(nb > 0) as ib, max(na <> nb) as df from (
              select k, v, sum(a) as na, sum(b) as nb from (
                select k, v, 1 as a, 0 as b from {x} union all select k, v, 0, 1 from {y}) group by k, v) group by k"""
        for x, y in pairs
    )
    return f"""q as (select k, max(ia) as ia, max(ib) as ib, max(df) as df from ({parts}) group by k)
select coalesce(sum(case when ia <> ib then 1 when df then 2 else 0 end), 0)::bigint as distance from q"""


@register(f"with {_TABLES}, {_keys_sql([('c1', 'c2'), ('o1', 'o2')])}")
def add_remove_keys(spark, folder):
    return D.add_remove_keys(_customer_tables(spark, folder))


@register(f"""
with {NEIGHBOUR}, {_net('user_id, event_type, value')},
g as (select event_type, sum(abs(na - nb)) as r from net group by 1)
select round(sqrt(sum(r::double * r::double)), 6) as distance from g
""")
def grouped_root_distance(spark, folder):
    e, f = [t.drop("event_id") for t in _pair(spark, folder)]
    answer = D.if_grouped_by(e, f, "event_type", "root_sum_squares")
    return answer.withColumn("distance", F.round("distance", 6))


@register(f"""
with {NEIGHBOUR}, {_net('user_id, event_type, value')},
g as (select event_type, sum(abs(na - nb)) as r from net group by 1)
select sum(r)::bigint as distance from g
""")
def grouped_sum_distance(spark, folder):
    e, f = [t.drop("event_id") for t in _pair(spark, folder)]
    return D.if_grouped_by(e, f, "event_type")


@register(f"""
with {NEIGHBOUR}, {_net('event_id, user_id, event_type, value')},
h as (select count(*) as h from e full join f using (event_id)
      where e.user_id is distinct from f.user_id or e.value is distinct from f.value),
s as (select sum(abs(na - nb))::bigint as s from net)
select s as symmetric, h as hamming, s <= 2 * h as bounded from s, h
""")
def symmetric_within_twice_hamming(spark, folder):
    """Changing a row counts twice as adding and removing, so this must always hold."""
    e, f = _pair(spark, folder)
    both = D.dict_metric({"s": D.symmetric_difference(e, f), "h": D.hamming(e, f, ["event_id"])})
    wide = both.agg(
        F.max(F.when(F.col("name") == "s", F.col("distance"))).cast("bigint").alias("symmetric"),
        F.max(F.when(F.col("name") == "h", F.col("distance"))).cast("bigint").alias("hamming"),
    )
    return wide.withColumn("bounded", F.col("symmetric") <= 2 * F.col("hamming"))


@register("""
with o as (select o_custkey, o_orderstatus from orders),
gone as (select c_custkey from customer where c_mktsegment = 'BUILDING')
select (select count(distinct o_custkey) from o where o_custkey in (select c_custkey from gone)) as removed,
       (select count(distinct s_suppkey) from supplier) as added
""")
def add_and_remove_keys(spark, folder):
    """Removing, and adding, all rows of some keys moves a table by exactly that many keys."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus")
    gone = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'")
    fewer = D.remove_keys(orders, gone.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    new = table(spark, folder, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("o_custkey"), F.lit("N").alias("o_orderstatus")
    )
    more = D.add_keys(orders, new)
    both = D.dict_metric({
        "removed": D.add_remove_keys({"orders": (orders, fewer, "o_custkey")}),
        "added": D.add_remove_keys({"orders": (orders, more, "o_custkey")}),
    })
    pick = [F.max(F.when(F.col("name") == n, F.col("distance"))).cast("bigint").alias(n) for n in ("removed", "added")]
    return both.agg(*pick)
