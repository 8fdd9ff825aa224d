"""Joins and public key sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import keysets as K
from hushframe.operators.private import dp_group_count
from hushframe.plans.evaluation import EPSILONS, dataset_moments, trial_grid
from workload.registry import register, table
from workload.sql import NOISE, SEED, d, geometric, h52


@register("""
select c_custkey, n_nationkey, c_mktsegment, n_name,
       (select max(c) from (select count(*) as c from nation group by n_nationkey)) as multiplicity
from customer join nation on c_nationkey = n_nationkey
""")
def join_public(spark, folder):
    people = table(spark, folder, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")
    )
    public = table(spark, folder, "nation").select("n_nationkey", "n_name")
    factor = K.public_multiplicity(public, ["n_nationkey"])
    joined = K.join_public(people, public, ["n_nationkey"])
    return joined.withColumn("multiplicity", F.lit(factor).cast("bigint"))


@register(f"""
with a as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey
             order by {h52(SEED, 'o_orderkey')}, o_orderkey) as rn from orders),
b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() over (partition by l_orderkey
             order by {h52(SEED, 'l_linenumber', 'l_partkey', 'l_suppkey', 'l_quantity')},
             l_linenumber, l_partkey, l_suppkey, l_quantity) as rn from lineitem)
select o_custkey, o_orderkey as orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
from a join b on o_orderkey = l_orderkey where b.rn <= 2
""")
def join_private(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("orderkey"))
    line = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("orderkey"), *line)
    return K.join_private(orders, lines, ["orderkey"], 1, 2, ["o_custkey"], line, SEED, "md5")


@register(f"""
with k as (select n_nationkey as c_nationkey from nation where n_regionkey <> 2),
c as (select k.c_nationkey, count(c_custkey) as n from k left join
        (select * from customer where c_mktsegment = 'BUILDING' and c_acctbal > 8000) using (c_nationkey) group by 1)
select c_nationkey, n + {geometric('count_rows', d(1.0), 'c_nationkey')} as "count" from c
""")
def group_by_keyset(spark, folder):
    keys = table(spark, folder, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"))
    people = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 8000")
    return dp_group_count(people, keys, ["c_nationkey"], 1.0, NOISE)


@register("select n_nationkey, n_name, r_name from nation, region")
def keyset_product(spark, folder):
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return K.keyset_product(nations, table(spark, folder, "region").select("r_name"))


@register("""
select l_returnflag, count(*) as n, sum(l_quantity::decimal(18, 2))::double as quantity from lineitem
where l_partkey in (select p_partkey from part where p_size <= 10) group by 1
""")
def restrict_to_keys(spark, folder):
    keys = table(spark, folder, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    kept = K.restrict_to_keys(lines, keys, ["l_partkey"])
    quantity = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), quantity.alias("quantity"))


_EPSILONS = "[" + ", ".join(d(e) for e in EPSILONS) + "]"


@register(f"""
with m as (select l_returnflag as dataset, count(*) as n from lineitem group by 1),
p as (select unnest(['COUNT', 'MEAN']) as query, unnest(['geometric', 'public_size']) as mechanism)
select dataset, query, mechanism, e.epsilon, i.iteration::int as iteration, n
from m, p, (select unnest({_EPSILONS}) as epsilon) e, (select unnest(range(1, 11)) as iteration) i
""")
def trial_settings(spark, folder):
    moments = dataset_moments(table(spark, folder, "lineitem"), "l_returnflag", "l_quantity", 0, 60, 1)
    pairs = [("COUNT", "geometric"), ("MEAN", "public_size")]
    rows = trial_grid(moments.select("dataset", "n"), EPSILONS, 10, pairs)
    return rows.select("dataset", "query", "mechanism", "epsilon", "iteration", "n")
