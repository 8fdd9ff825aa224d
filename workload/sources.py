"""Readers and writers, on files that Spark writes from the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hushframe.operators.ids import id_statistics, with_line_number, with_privacy_id
from hushframe.plans.materialise import new_path
from hushframe.sources import generators as G
from hushframe.sources import results as R
from hushframe.sources import tables as T
from workload.registry import register, table
from workload.sql import SEED, d, plain_uniform

_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


@register("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def read_csv_table(spark, folder):
    path = new_path(spark, "orders-csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    table(spark, folder, "orders").select(*columns).write.option("header", True).csv(path)
    return T.read_table(spark, path, _ORDERS)


@register("select o_orderkey, o_totalprice from orders where o_totalprice > 250000")
def read_parquet_columns(spark, folder):
    schema = "o_orderkey bigint, o_totalprice double"
    return T.read_table(spark, f"{folder}/orders.parquet", schema).filter("o_totalprice > 250000")


@register("""
select count(*) as n, round(sum(value), 2) as "sum", min(value) as "min", max(value) as "max" from events
""")
def read_numeric_lines(spark, folder):
    """Number lines with header lines in between, which do not parse and are dropped."""
    path = new_path(spark, "lines")
    table(spark, folder, "events").select("value").write.option("header", True).csv(path)
    numbers = T.read_numeric_lines(spark, path)
    total = F.round(F.sum("value"), 2).alias("sum")
    return numbers.agg(F.count("*").alias("n"), total, F.min("value").alias("min"), F.max("value").alias("max"))


@register("""
select event_id, user_id, event_type,
       coalesce(try_cast(case when event_type = 'error' then 'none' else value::varchar end as double), 0) as value from events
""")
def split_text_lines(spark, folder):
    value = F.when(F.col("event_type") == "error", "none").otherwise(F.col("value").cast("string"))
    lines = table(spark, folder, "events").select(F.concat_ws(",", "event_id", "user_id", "event_type", value).alias("value"))
    parts = T.split_lines(lines, ["event_id", "user_id", "event_type", "value"])
    return parts.select(
        F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"),
        "event_type", T.cast_or_default("value", "double", 0.0).alias("value"),
    )


# Dataset names from the lines: size by line number, scale by return flag, skew by line status.
DATASET_SQL = """'data_' || l_linenumber * 1000 || '_' || case l_returnflag when 'A' then 50 when 'N' then 250 else 500 end
  || '_' || case l_linestatus when 'F' then 0 else 5 end || '.csv'"""


def dataset_name():
    scale = F.when(F.col("l_returnflag") == "A", 50).when(F.col("l_returnflag") == "N", 250).otherwise(500)
    skew = F.when(F.col("l_linestatus") == "F", 0).otherwise(5)
    parts = [F.lit("data"), F.col("l_linenumber") * 1000, scale, skew]
    return F.concat(F.concat_ws("_", *parts), F.lit(".csv"))


@register(f"""
with x as (select {DATASET_SQL} as dataset, l_quantity from lineitem)
select dataset, regexp_extract(dataset, 'data_(\\d+)_(\\d+)_(\\d+)', 1)::bigint as dataset_size,
       regexp_extract(dataset, 'data_(\\d+)_(\\d+)_(\\d+)', 2)::int as dataset_scale,
       regexp_extract(dataset, 'data_(\\d+)_(\\d+)_(\\d+)', 3)::int as dataset_skew,
       count(*) as n, round(sum(l_quantity), 2) as "sum" from x group by all
""")
def read_dataset_folder(spark, folder):
    """All datasets are written as CSV in one job and read back in one job."""
    path = new_path(spark, "datasets")
    rows = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("values"), dataset_name().alias("dataset"))
    T.write_dataset_dir(rows, path)
    read = T.read_dataset_dir(spark, path, "values double").withColumns(T.dataset_features())
    keys = ["dataset", "dataset_size", "dataset_scale", "dataset_skew"]
    return read.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("values"), 2).alias("sum"))


_RESULT = "query string, mechanism string, dataset_size bigint, l_linestatus string, n bigint"


def _results(spark, folder):
    return table(spark, folder, "lineitem").groupBy(
        F.lit("COUNT").alias("query"), F.col("l_returnflag").alias("mechanism"),
        (F.col("l_linenumber") * 1000).cast("bigint").alias("dataset_size"), "l_linestatus",
    ).agg(F.count("*").alias("n"))


@register("""
select 'COUNT' as query, l_returnflag as mechanism, (l_linenumber * 1000)::bigint as dataset_size, l_linestatus, count(*) as n
from lineitem group by all
""")
def append_results(spark, folder):
    """Two runs append to one table, the first one twice as if tried again; it is read back whole."""
    path = new_path(spark, "results")
    results = _results(spark, folder)
    R.append_results(results.filter("l_linestatus = 'F'"), path, "first")
    R.append_results(results.filter("l_linestatus <> 'F'"), path, "second")
    R.append_results(results.filter("l_linestatus = 'F'"), path, "first")
    return R.read_results(spark, path, _RESULT).select("query", "mechanism", "dataset_size", "l_linestatus", "n")


@register("""
with grid as (select distinct l_returnflag as mechanism, (l_linenumber * 1000)::bigint as dataset_size, e.epsilon
              from lineitem, (select unnest(['0.1'::double, '1.0'::double, '10.0'::double]) as epsilon) e),
done as (select distinct l_returnflag as mechanism, (l_linenumber * 1000)::bigint as dataset_size,
                case when l_linestatus = 'F' then '0.1'::double else '1.0'::double end as epsilon from lineitem
         where l_quantity > 20 and l_returnflag <> 'R')
select * from grid where (mechanism, dataset_size, epsilon) not in (select mechanism, dataset_size, epsilon from done)
""")
def pending_trials(spark, folder):
    lines = table(spark, folder, "lineitem")
    size = (F.col("l_linenumber") * 1000).cast("bigint").alias("dataset_size")
    mechanism = F.col("l_returnflag").alias("mechanism")
    settings = lines.select(mechanism, size).distinct()
    grid = settings.withColumn("epsilon", F.explode(F.array(F.lit(0.1), F.lit(1.0), F.lit(10.0))))
    epsilon = F.when(F.col("l_linestatus") == "F", 0.1).otherwise(1.0).alias("epsilon")
    done = lines.filter("l_quantity > 20 AND l_returnflag <> 'R'").select(mechanism, size, epsilon)
    return R.pending_trials(grid, done, ["mechanism", "dataset_size", "epsilon"])


@register("""
select count(*) as n, 1::bigint as first, count(*) as last, count(*) as ids, count(*) as loose_ids from lineitem
""")
def privacy_ids(spark, folder):
    """Numbers without gaps, and cheaper ids that are only distinct."""
    lines = table(spark, folder, "lineitem").select("l_orderkey")
    numbered = with_line_number(with_privacy_id(lines, "loose"), "id")
    found = id_statistics(numbered, ["id", "loose"])
    one = lambda name, column: F.max(F.when(F.col("name") == name, F.col(column)))
    return found.agg(
        F.coalesce(one("id", "n"), F.lit(0)).alias("n"), one("id", "first").alias("first"),
        one("id", "last").alias("last"), F.coalesce(one("id", "ids"), F.lit(0)).alias("ids"),
        F.coalesce(one("loose", "ids"), F.lit(0)).alias("loose_ids"),
    )


def _skew_sql(scale: str, skew: float) -> str:
    u1, u2 = plain_uniform(SEED, "'z1'", "o_orderkey"), plain_uniform(SEED, "'z2'", "o_orderkey")
    radius, angle = f"sqrt({d(-2)} * ln({u1}))", f"{d(2 * math.pi)} * {u2}"
    part = skew / math.sqrt(1 + skew * skew)
    rest = math.sqrt(1 - part * part)
    return f"({scale} * ({d(part)} * abs({radius} * cos({angle})) + {d(rest)} * {radius} * sin({angle})))"


_SCALE = "case o_orderstatus when 'F' then 50.0::double when 'O' then 250.0::double else 500.0::double end"


@register(f"""
select o_orderkey, {', '.join(f"round({_skew_sql(_SCALE, s)}, 2) as skew_{s}" for s in G.SKEWS)} from orders
""")
def skew_normal_samples(spark, folder):
    """One sample per order and skew, scaled by the order status."""
    scale = F.when(F.col("o_orderstatus") == "F", 50.0).when(F.col("o_orderstatus") == "O", 250.0).otherwise(500.0)
    drawn = [G.skew_normal(SEED, scale, s, "o_orderkey", algorithm="md5").alias(f"skew_{s}") for s in G.SKEWS]
    return table(spark, folder, "orders").select("o_orderkey", *drawn)


def _polynomial_sql(coefficients, x: str) -> str:
    value = d(coefficients[0])
    for c in coefficients[1:]:
        value = f"({value} * {x} + {d(c)})"
    return value


def _tail_sql(share: str) -> str:
    x = f"sqrt({d(-2)} * ln({share}))"
    return f"{_polynomial_sql(G.TAIL_TOP, x)} / {_polynomial_sql(G.TAIL_BOTTOM, x)}"


def _income_sql(key: str) -> str:
    from statistics import NormalDist

    start, stop = NormalDist().cdf(0.6), NormalDist().cdf(3.0)
    p = f"({d(start)} + {plain_uniform(SEED, chr(39) + 'income' + chr(39), key)} * {d(stop - start)})"
    centred = f"({p} - {d(0.5)})"
    square = f"({centred} * {centred})"
    centre = f"{centred} * {_polynomial_sql(G.CENTRE_TOP, square)} / {_polynomial_sql(G.CENTRE_BOTTOM, square)}"
    law = f"case when {p} < {d(G.TAIL)} then {_tail_sql(p)} when {p} > {d(1 - G.TAIL)} then -({_tail_sql(f'({d(1)} - {p})')}) else {centre} end"
    return f"greatest(least({d(0)} + {d(5000)} * ({law}), {d(15000)}), {d(3000)})"


@register(f"""
select c_custkey, floor({plain_uniform(SEED, "'age'", 'c_custkey')} * {d(121)})::int as age,
       round({d(50)} + {plain_uniform(SEED, "'height'", 'c_custkey')} * {d(150)}, 2) as height,
       round({_income_sql('c_custkey')}, 4) as income from customer
""")
def demographics_samples(spark, folder):
    """Age, height and income for each customer."""
    columns = [c.alias(n) for n, c in G.demographics(SEED, "c_custkey", algorithm="md5").items()]
    people = table(spark, folder, "customer").select("c_custkey", *columns)
    return people.withColumn("income", F.round("income", 4))


_U1, _U2 = (plain_uniform(SEED, f"'{z}'", "scale", "skew", "id") for z in ("z1", "z2"))


@register(f"""
with s as (select unnest({[float(x) for x in G.SCALES]})::double as scale),
t as (select unnest({[float(x) for x in G.SKEWS]})::double as skew),
i as (select unnest(range(n)) as id, n from (select count(*) as n from orders)),
x as (select *, skew / sqrt(1 + skew * skew) as part, sqrt({d(-2)} * ln({_U1})) as radius, {d(2 * math.pi)} * {_U2} as angle from i, s, t)
select 'data_' || n || '_' || scale::int || '_' || skew::int || '.csv' as dataset,
       round(scale * (part * abs(radius * cos(angle)) + sqrt(1 - part * part) * radius * sin(angle)), 2) as "values" from x
""")
def skew_normal_datasets(spark, folder):
    """Every scale and skew as a dataset with as many rows as there are orders."""
    return G.skew_normal_datasets(spark, table(spark, folder, "orders").count(), SEED, algorithm="md5")


@register(f"""
with i as (select unnest(range(n)) as id from (select count(*) as n from customer))
select floor({plain_uniform(SEED, "'age'", 'id')} * {d(121)})::int as age,
       round({d(50)} + {plain_uniform(SEED, "'height'", 'id')} * {d(150)}, 2) as height,
       round({_income_sql('id')}, 4) as income from i
""")
def demographics_table(spark, folder):
    """A table with as many people as there are customers."""
    people = G.demographics_table(spark, table(spark, folder, "customer").count(), SEED, algorithm="md5")
    return people.withColumn("income", F.round("income", 4))
