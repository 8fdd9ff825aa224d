"""Exact and private aggregates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hushframe.functions.calibration import selection_threshold
from hushframe.operators import private as P
from hushframe.operators import resize as R
from hushframe.operators.bounding import PrivacyUnit
from hushframe.operators.exact import exact_stats
from hushframe.operators.keysets import declared_keys, with_domains
from hushframe.operators.vectors import dp_vector_sum
from hushframe.plans.adaptive import two_phase_count
from workload.bounding import BOUNDED_EVENTS, BOUNDED_TYPES, USER
from workload.registry import register, table
from workload.sql import NOISE, SEED, clamp, d, gaussian, geometric, h52, laplace, u

# Declared key domains
FLAGS = ["A", "N", "R"]
TYPES = ["click", "error", "purchase", "signup", "view", "other"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@register("""
select count(*) as "rows", count(x) as "count", round(sum(x::decimal(18, 2)), 2)::double as "sum",
       round(avg(x), 6) as mean, round(var_samp(x), 4) as var_samp, round(var_pop(x), 4) as var_pop,
       round(stddev_samp(x), 6) as stddev_samp, round(stddev_pop(x), 6) as stddev_pop,
       min(x) as "min", max(x) as "max"
from (select case when l_returnflag <> 'N' then l_extendedprice end as x from lineitem)
""")
def exact_statistics(spark, folder):
    x = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))
    stats = exact_stats(table(spark, folder, "lineitem"), x)
    digits = {"sum": 2, "mean": 6, "var_samp": 4, "var_pop": 4, "stddev_samp": 6, "stddev_pop": 6}
    return stats.withColumns({c: F.round(c, n) for c, n in digits.items()})


@register("""
select l_returnflag, l_linestatus, count(*) as "rows", round(sum(l_quantity), 2) as "sum",
       round(avg(l_quantity), 6) as mean, round(var_samp(l_quantity), 6) as var_samp,
       min(l_quantity) as "min", max(l_quantity) as "max"
from lineitem group by 1, 2
""")
def exact_by_group(spark, folder):
    chosen = ["rows", "sum", "mean", "var_samp", "min", "max"]
    stats = exact_stats(table(spark, folder, "lineitem"), "l_quantity", chosen, ["l_returnflag", "l_linestatus"])
    return stats.withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 6), "var_samp": F.round("var_samp", 6)})


@register(f"select count(*) + {geometric('count_rows', d(2.0))} as \"count\" from lineitem")
def dp_count(spark, folder):
    return P.dp_count(table(spark, folder, "lineitem"), 0.5, NOISE)


@register(f"""
with r as (select *, row_number() over (partition by user_id order by {h52(SEED, 'event_id')}, event_id) as rn from events)
select count(*) + {laplace('count_rows', d(1.0))} as "count" from r where rn <= 1
""")
def dp_count_laplace(spark, folder):
    """One row per privacy id, one global partition, real-valued noise."""
    unit = PrivacyUnit("user_id", row_key=("event_id",), seed=SEED, algorithm="md5")
    return P.dp_count(table(spark, folder, "events"), 1.0, NOISE, unit=unit, count_mechanism="laplace")


@register(f"""
with k as (select unnest(['A', 'N', 'R']) as l_returnflag),
c as (select l_returnflag, count(l_orderkey) as n from k left join
        (select * from lineitem where l_quantity >= 18) using (l_returnflag) group by 1)
select l_returnflag, n + {geometric('count_rows', d(2.0), 'l_returnflag')} as "count" from c
""")
def dp_filtered_count(spark, folder):
    lines = table(spark, folder, "lineitem")
    return P.dp_filtered_count(
        lines, "l_quantity >= 18", 0.5, NOISE, by=["l_returnflag"], keyset=declared_keys(spark, {"l_returnflag": FLAGS})
    )


@register(f"""
with c as (select count(*) + {geometric('count_rows', d(4.0))} as n from lineitem where l_discount <> 0)
select n as "count", round(n / (select 4.0::double * count(*) from orders), 9) as share from c
""")
def dp_count_nonzero(spark, folder):
    n = 4 * table(spark, folder, "orders").count()
    counted = P.dp_count_nonzero(table(spark, folder, "lineitem"), "l_discount", 0.25, NOISE, n=n)
    return _rounded(counted, 9, "share")


@register(f"""
with {BOUNDED_TYPES},
k as (select unnest(['click', 'error', 'purchase', 'signup', 'view', 'other']) as event_type),
c as (select event_type, count(user_id) as n from k left join
        (select * from p where pn <= 2) using (event_type) group by 1)
select event_type, n + {geometric('privacy_id_count', d(4.0), 'event_type')} as privacy_id_count from c
""")
def dp_privacy_id_count(spark, folder):
    keys = declared_keys(spark, {"event_type": TYPES})
    return P.dp_privacy_id_count(table(spark, folder, "events"), USER, 0.5, NOISE, by=["event_type"], keyset=keys)


@register(f"""
with s as (select sum({clamp('l_extendedprice', 0, 50000)}::decimal(18, 2))::double as s from lineitem)
select round(s + {laplace('sum_sum', d(50000.0))}, 2) as "sum" from s
""")
def dp_sum(spark, folder):
    answer = P.dp_sum(table(spark, folder, "lineitem"), "l_extendedprice", 0, 50000, 1.0, NOISE)
    return _rounded(answer, 2, "sum")


@register(f"""
with s as (select sum(round({clamp('l_extendedprice', 0, 50000)} / {d(0.01)})::decimal(18, 0)) as s from lineitem)
select round((s + {geometric('sum_sum', d(5000000.0))})::double * {d(0.01)}, 2) as "sum" from s
""")
def dp_sum_on_grid(spark, folder):
    answer = P.dp_sum(table(spark, folder, "lineitem"), "l_extendedprice", 0, 50000, 1.0, NOISE, grid=0.01)
    return _rounded(answer, 2, "sum")


def _moments(c: str, low: float, high: float, source: str) -> str:
    middle = (low + high) / 2.0
    return f"""m as (select count(x) as n, coalesce(sum(x - {d(middle)}), 0) as m1,
      coalesce(sum((x - {d(middle)}) * (x - {d(middle)})), 0) as m2
      from (select {clamp(c, low, high)} as x from {source}))"""


def _mean(low: float, high: float, epsilon: float, name: str = "mean") -> str:
    n = f"greatest((n + {geometric(name + '_n', d(2 / epsilon))})::double, {d(1)})"
    m1 = f"(m1 + {laplace(name + '_m1', d((high - low) / 2 / (epsilon / 2)))})"
    return f"greatest(least({d((low + high) / 2)} + {m1} / {n}, {d(high)}), {d(low)})"


def _variance(low: float, high: float, epsilon: float, name: str = "variance") -> str:
    half = (high - low) / 2
    share = epsilon / 3
    n = f"greatest((n + {geometric(name + '_n', d(1 / share))})::double, {d(1)})"
    m1 = f"((m1 + {laplace(name + '_m1', d(half / share))}) / {n})"
    m2 = f"((m2 + {laplace(name + '_m2', d(half * half / share))}) / {n})"
    return f"greatest(least({m2} - {m1} * {m1}, {d(half * half)}), {d(0)})"


@register(f"with {_moments('l_quantity', 0, 60, 'lineitem')} select round({_mean(0, 60, 1.0)}, 6) as mean from m")
def dp_mean(spark, folder):
    return _rounded(P.dp_mean(table(spark, folder, "lineitem"), "l_quantity", 0, 60, 1.0, NOISE), 6, "mean")


@register(f"with {_moments('l_quantity', 0, 60, 'lineitem')} select round({_variance(0, 60, 1.0)}, 6) as variance from m")
def dp_variance(spark, folder):
    answer = P.dp_variance(table(spark, folder, "lineitem"), "l_quantity", 0, 60, 1.0, NOISE)
    return _rounded(answer, 6, "variance")


@register(f"with {_moments('l_quantity', 0, 60, 'lineitem')} select round(sqrt({_variance(0, 60, 1.0, 'std')}), 6) as std from m")
def dp_std(spark, folder):
    return _rounded(P.dp_std(table(spark, folder, "lineitem"), "l_quantity", 0, 60, 1.0, NOISE), 6, "std")


_NAN_EVENTS = "(select case when event_type = 'error' then 'nan'::double else value end as v from events)"


@register(f"""
with {_moments('v', 0, 500, _NAN_EVENTS)},
s as (select sum({clamp('v', 0, 500)}::decimal(18, 2))::double as s from {_NAN_EVENTS})
select round(s + {laplace('sum_sum', d(500 / 0.25))}, 6) as "sum", round({_mean(0, 500, 0.25)}, 6) as mean,
       round({_variance(0, 500, 0.25)}, 4) as variance, round(sqrt({_variance(0, 500, 0.25, 'std')}), 6) as std
from m, s
""")
def dp_skip_nan(spark, folder):
    """Sum, mean, variance and deviation of a column with NaN, in one pass."""
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    metrics = ["sum", "mean", "variance", "std"]
    answer = P.dp_aggregate(table(spark, folder, "events"), metrics, 1.0, NOISE, value=v, low=0, high=500)
    return _rounded(_rounded(answer, 6, "sum", "mean", "std"), 4, "variance")


_ONE_EACH = f"""(
select value from (select *, row_number() over (partition by user_id order by {h52(SEED, 'event_id')}, event_id) as rn from events)
where rn <= 1)"""


@register(f"""
with {_moments('value', 0, 400, _ONE_EACH)},
s as (select sum({clamp('value', 0, 400)}::decimal(18, 2))::double as s from {_ONE_EACH})
select round(s + {laplace('sum_sum', d(400 / 0.5))}, 6) as "sum", round({_mean(0, 400, 0.5)}, 6) as mean,
       round({_variance(0, 400, 0.5)}, 4) as variance from m, s
""")
def dp_one_row_per_person(spark, folder):
    """Sum, mean and variance over one row of each person."""
    unit = PrivacyUnit("user_id", row_key=("event_id",), seed=SEED, algorithm="md5")
    answer = P.dp_aggregate(
        table(spark, folder, "events"), ["sum", "mean", "variance"], 1.5, NOISE, value="value", low=0, high=400, unit=unit
    )
    return _rounded(_rounded(answer, 6, "sum", "mean"), 4, "variance")


def _sized(low: float, high: float) -> str:
    """Values of the 3 x orders rows that come first in hash order."""
    key = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"
    parts = [c.strip() for c in key.split(",")]
    return f"""n as (select 3 * count(*) as n from orders),
r as (select l_quantity, row_number() over (order by {h52(SEED, *parts)}, {key}) as rn from lineitem),
x as (select {clamp('l_quantity', low, high)} as x from r where rn <= (select n from n))"""


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )


@register(f"""with {_sized(5, 40)}
select round(avg(x) + {laplace('mean', f"({d(35)} / max(n)) / {d(0.5)}")}, 6) as mean from x, n""")
def dp_mean_sized(spark, folder):
    n = 3 * table(spark, folder, "orders").count()
    return _rounded(R.dp_mean_sized(_lines(spark, folder), "l_quantity", 5, 40, n, 0.5, NOISE, seed=SEED, algorithm="md5"), 6, "mean")


@register(f"""with {_sized(5, 40)}
select round(var_samp(x) + {laplace('variance', f"({d(35 * 35)} / max(n)) / {d(0.5)}")}, 6) as variance from x, n""")
def dp_variance_sized(spark, folder):
    n = 3 * table(spark, folder, "orders").count()
    answer = R.dp_variance_sized(_lines(spark, folder), "l_quantity", 5, 40, n, 0.5, NOISE, ddof=1, seed=SEED, algorithm="md5")
    return _rounded(answer, 6, "variance")


@register(f"""with n as (select 5 * count(*) as n from orders),
s as (select sum({clamp('l_quantity', 5, 40)}) + ((select n from n) - count(*)) * {d(10)} as s from lineitem)
select round(s + {laplace('sum', d(35 / 0.5))}, 4) as "sum" from s""")
def dp_sum_sized(spark, folder):
    """Declared size above the real one: the missing rows count as the constant 10."""
    n = 5 * table(spark, folder, "orders").count()
    answer = R.dp_sum_sized(_lines(spark, folder), "l_quantity", 5, 40, n, 0.5, NOISE, constant=10.0, seed=SEED, algorithm="md5")
    return _rounded(answer, 4, "sum")


@register(f"""
with k as (select n_nationkey as c_nationkey, s.segment as c_mktsegment from nation,
           (select unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) as segment) s),
c as (select c_nationkey, c_mktsegment, count(c_custkey) as n from k
      left join customer using (c_nationkey, c_mktsegment) group by 1, 2)
select c_nationkey, c_mktsegment, n + {geometric('count_rows', d(1.0), 'c_nationkey', 'c_mktsegment')} as "count" from c
""")
def dp_group_count(spark, folder):
    return P.dp_group_count(
        table(spark, folder, "customer"), _cells(spark, folder), ["c_nationkey", "c_mktsegment"], 1.0, NOISE
    )


def _cells(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return with_domains(nations, {"c_mktsegment": SEGMENTS})


THRESHOLD = selection_threshold(0.5, 1e-5, 2)


@register(f"""
with {BOUNDED_TYPES}, c as (select event_type, count(*) as n from p where pn <= 2 group by 1),
noisy as (select event_type, n + {laplace('noisy_ids', d(4.0), 'event_type')} as noisy_ids from c)
select event_type, round(noisy_ids, 6) as noisy_ids from noisy where noisy_ids >= {d(THRESHOLD)}
""")
def select_partitions(spark, folder):
    kept = P.select_partitions(table(spark, folder, "events"), USER, ["event_type"], 0.5, 1e-5, NOISE)
    return _rounded(kept, 6, "noisy_ids")


CUSTOMER = PrivacyUnit("o_custkey", partitions=3, rows=1, row_key=("o_orderkey",), seed=SEED, algorithm="md5")
MONTHS = selection_threshold(1.0, 1e-3, 3)


@register(f"""
with o as (select o_custkey, o_orderkey, cast(year(o_orderdate) * 100 + month(o_orderdate) as int) as o_month from orders),
p as (select o_custkey, o_month, row_number() over (partition by o_custkey
        order by {h52(SEED, 'o_custkey', 'o_month')}, o_month) as pn from (select distinct o_custkey, o_month from o)),
c as (select o_month, count(*) as n from p where pn <= 3 group by 1),
noisy as (select o_month, n + {laplace('noisy_ids', d(3.0), 'o_month')} as noisy_ids from c)
select o_month, round(noisy_ids, 6) as noisy_ids from noisy where noisy_ids >= {d(MONTHS)}
""")
def select_rare_partitions(spark, folder):
    """Many keys with few customers each, so that the threshold really removes some."""
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("o_month")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", month)
    kept = P.select_partitions(orders, CUSTOMER, ["o_month"], 1.0, 1e-3, NOISE)
    return _rounded(kept, 6, "noisy_ids")


_E, _D = 1.0 / 3, 1 - (1 - 1e-3) ** (1 / 3)


@register(f"""
with recursive o as (select o_custkey, o_orderkey, cast(year(o_orderdate) * 100 + month(o_orderdate) as int) as o_month from orders),
p as (select o_custkey, o_month, row_number() over (partition by o_custkey
        order by {h52(SEED, 'o_custkey', 'o_month')}, o_month) as pn from (select distinct o_custkey, o_month from o)),
c as (select o_month, count(*) as n from p where pn <= 3 group by 1),
chance as (select 0 as n, {d(0)} as p union all
           select n + 1, least(exp({d(_E)}) * p + {d(_D)}, 1 - exp({d(-_E)}) * (1 - p - {d(_D)}), 1)
           from chance where n < (select max(n) from c))
select o_month from c join chance using (n) where {u('selected', 1, 'o_month')} < p
""")
def select_partitions_optimal(spark, folder):
    """The same keys, each by the largest chance of release that its customers allow; SQL runs the recurrence."""
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("o_month")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", month)
    return P.select_partitions_optimal(orders, CUSTOMER, ["o_month"], 1.0, 1e-3, NOISE)


_TYPES = "['click', 'error', 'purchase', 'signup', 'view', 'other']"


@register(f"""
with {BOUNDED_EVENTS},
k as (select unnest({_TYPES}) as event_type),
b as (select event_type, user_id, rn, {clamp('value', 0, 400)} as x from bounded),
m as (select event_type, count(user_id) as n, count(case when rn = 1 then 1 end) as ids, coalesce(sum(x), 0) as s,
             coalesce(sum(x - {d(200)}), 0) as m1 from k left join b using (event_type) group by 1)
select event_type, n + {geometric('count_rows', d(6 / 0.5), 'event_type')} as "count",
       ids + {geometric('privacy_id_count_ids', d(2 / 0.5), 'event_type')} as privacy_id_count,
       round(s + {laplace('sum_sum', d(6 * 400 / 0.5), 'event_type')}, 6) as "sum",
       round(greatest(least({d(200)} + (m1 + {laplace('mean_m1', d(6 * 200 / 0.25), 'event_type')})
         / greatest((n + {geometric('mean_n', d(6 / 0.25), 'event_type')})::double, {d(1)}), {d(400)}), {d(0)}), 6) as mean
from m
""")
def dp_aggregate(spark, folder):
    """Four metrics per public group in one pass, with both contribution bounds."""
    keys = declared_keys(spark, {"event_type": TYPES})
    answer = P.dp_aggregate(
        table(spark, folder, "events"), ["count", "privacy_id_count", "sum", "mean"], 2.0, NOISE,
        value="value", low=0, high=400, by=["event_type"], keyset=keys, unit=USER,
    )
    return _rounded(answer, 6, "sum", "mean")


_FOUND = selection_threshold(1.0, 1e-3, 3)


@register(f"""
with o as (select o_custkey, o_orderkey, cast(year(o_orderdate) * 100 + month(o_orderdate) as int) as o_month, o_totalprice from orders),
r as (select *, row_number() over (partition by o_custkey, o_month order by {h52(SEED, 'o_orderkey')}, o_orderkey) as rn from o),
p as (select o_custkey, o_month, row_number() over (partition by o_custkey
        order by {h52(SEED, 'o_custkey', 'o_month')}, o_month) as pn from (select distinct o_custkey, o_month from o)),
b as (select o_month, {clamp('o_totalprice', 0, 300000)} as x from r join p using (o_custkey, o_month) where rn <= 1 and pn <= 3),
m as (select o_month, count(*) as n, sum(x::decimal(18, 2))::double as s from b group by 1),
noisy as (select o_month, n + {geometric('count_rows', d(6.0), 'o_month')} as "count",
            s + {laplace('sum_sum', d(3 * 300000 / 0.5), 'o_month')} as "sum",
            n + {laplace('selected_ids', d(3.0), 'o_month')} as ids from m)
select o_month, "count", round("sum", 4) as "sum" from noisy where ids >= {d(_FOUND)}
""")
def dp_aggregate_found_keys(spark, folder):
    """Metrics for keys that are found in the private data, paid for with delta."""
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("o_month")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", month)
    answer = P.dp_aggregate(
        orders, ["count", "sum"], 1.0, NOISE, value="o_totalprice", low=0, high=300000,
        by=["o_month"], selection=(1.0, 1e-3), unit=CUSTOMER,
    )
    return _rounded(answer, 4, "sum")


def _vector_sql(norm: str, clip: float, noise: str) -> str:
    length = {
        "l2": "sqrt(list_sum([x::double * x::double for x in embedding]))",
        "l1": "list_sum([abs(x::double) for x in embedding])",
    }[norm]
    return f"""
with v as (select embedding as e, least({d(1)}, coalesce({d(clip)} / nullif({length}, 0), 1)) as f from embeddings),
x as (select unnest(range(64))::int as pos, unnest(e)::double * f as x from v),
s as (select pos, sum(x) as s from x group by 1)
select pos, round(s + {noise}, 5) as value from s"""


@register(_vector_sql("l2", 0.8, gaussian("value", d(0.8**2 / (2 * 0.5)), "pos")))
def dp_vector_sum_l2(spark, folder):
    answer = dp_vector_sum(table(spark, folder, "embeddings"), "embedding", 64, 0.8, 0.5, NOISE)
    return _rounded(answer, 5, "value")


@register(_vector_sql("l1", 4.0, laplace("value", d(4.0), "pos")))
def dp_vector_sum_l1(spark, folder):
    answer = dp_vector_sum(table(spark, folder, "embeddings"), "embedding", 64, 4.0, 1.0, NOISE, norm="l1")
    return _rounded(answer, 5, "value")


@register(f"""
with v as (select vec_id, unnest(range(64))::int as pos, unnest(embedding)::double as x from embeddings),
c as (select vec_id, pos, case when pos = vec_id % 64 and vec_id % 5 < 3 then 0 else x end as x from v),
n as (select vec_id, sqrt(sum(x * x)) as n from c group by 1),
s as (select pos, sum(x * least({d(1)}, coalesce({d(0.8)} / nullif(n, 0), 1))) as s from c join n using (vec_id) group by 1)
select pos, round(s + {gaussian('value', d(0.8**2 / (2 * 0.5)), 'pos')}, 5) as value from s
""")
def dp_vector_sum_missing(spark, folder):
    """One element of most vectors is NULL, NaN or infinite, and some vectors are too long."""
    odd = F.when(F.col("vec_id") % 5 == 1, float("nan")).when(F.col("vec_id") % 5 == 2, float("inf"))
    broken = F.transform(
        "embedding", lambda x, i: F.when((i == F.col("vec_id") % 64) & (F.col("vec_id") % 5 < 3), odd).otherwise(x.cast("double"))
    )
    longer = F.when(F.col("vec_id") % 7 == 0, F.concat(broken, F.array(F.lit(1e9)))).otherwise(broken)
    vectors = table(spark, folder, "embeddings").select("vec_id", longer.alias("embedding"))
    return _rounded(dp_vector_sum(vectors, "embedding", 64, 0.8, 0.5, NOISE), 5, "value")


def discrete_gaussian_sql(source: str, columns: str, exact: str, label: str, sigma_sq: float, *keys: str) -> str:
    """``columns`` and noisy ``exact``: the first of many tries with geometric noise that its coin accepts."""
    width = float(math.floor(sigma_sq**0.5) + 1)

    def uniform(number: int) -> str:
        text = f"md5(concat_ws('|', '{SEED}', '{label}', 3 * a + {number}, {', '.join(keys)}))"
        return f"((cast(cast('0x' || substr({text}, 1, 13) as bigint) as double) + {d(0.5)}) / {d(4503599627370496.0)})"

    def one_sided(number: int) -> str:
        return f"cast(floor(ln({uniform(number)}) / ({d(-1)} / {d(width)})) as bigint)"

    gap = f"(abs(k)::double - {d(sigma_sq)} / {d(width)})"
    return f"""(
with s as (select *, row_number() over () as row_of from {source}),
t as (select *, unnest(range(64)) as a from s),
g as (select *, {one_sided(1)} - {one_sided(2)} as k, {uniform(3)} as coin from t),
f as (select row_of, arg_min(k, a) as k from g where coin < exp(-({gap} * {gap}) / ({d(2)} * {d(sigma_sq)})) group by 1)
select {columns}, {exact} + k as noisy from s join f using (row_of))"""


_RHO_SIGMA = 1.0 / (2 * 0.05)


@register(f"""
with g as (select n_nationkey as c_nationkey, count(c_custkey) as n
           from nation left join customer on c_nationkey = n_nationkey group by 1)
select c_nationkey, noisy as "count" from
{discrete_gaussian_sql('g', 'c_nationkey', 'n', 'count_rows', _RHO_SIGMA, 'c_nationkey')}
""")
def dp_group_count_zcdp(spark, folder):
    keys = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return P.dp_group_count(
        table(spark, folder, "customer"), keys, ["c_nationkey"], 0.05, NOISE, measure="zcdp"
    )


_FIRST, _SECOND = 1.0 / (2 * (0.5 * 0.1)), 1.0 / (2 * (0.5 * (1.0 - 0.1)))


@register(f"""
with g as (select n_nationkey as c_nationkey, count(c_custkey) as n
           from nation left join customer on c_nationkey = n_nationkey group by 1),
h as (select c_nationkey, case when noisy < 60 then 'true' else 'false' end as under_threshold from
  {discrete_gaussian_sql('g', 'c_nationkey', 'n', 'coarse_count', _FIRST, 'c_nationkey')}),
small as (select g.* from g join h using (c_nationkey) where under_threshold = 'true'),
cells as (select h.c_nationkey, s.seg as c_mktsegment from h,
           (select unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) as seg) s
          where under_threshold = 'false'),
large as (select c_nationkey, c_mktsegment, count(c_custkey) as n from cells
          left join customer using (c_nationkey, c_mktsegment) group by 1, 2)
select c_nationkey, null as c_mktsegment, 'true' as under_threshold, noisy as "count" from
  {discrete_gaussian_sql('small', 'c_nationkey', 'n', 'small_count', _SECOND, 'c_nationkey')}
union all
select c_nationkey, c_mktsegment, 'false' as under_threshold, noisy as "count" from
  {discrete_gaussian_sql('large', 'c_nationkey, c_mktsegment', 'n', 'large_count', _SECOND, 'c_nationkey', 'c_mktsegment')}
""")
def dp_two_phase_count(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return two_phase_count(
        table(spark, folder, "customer"), nations, ["c_nationkey"], _cells(spark, folder),
        ["c_nationkey", "c_mktsegment"], 0.5, 60, NOISE,
    )
