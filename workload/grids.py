"""Histograms and quantiles on public grids."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hushframe.functions.calibration import selection_threshold
from hushframe.operators import histograms as H
from hushframe.operators.bounding import PrivacyUnit
from hushframe.operators.keysets import declared_keys
from workload.registry import register, table
from workload.sql import NOISE, SEED, d, geometric, h52, laplace, u

VALUES = H.Axis("value", 0, 500, 50)
QUANTITY = H.Axis("l_quantity", 0, 50, 10)
DISCOUNT = H.Axis("l_discount", 0, 0.1, 5)
TAX = H.Axis("l_tax", 0, 0.08, 4)


def bin_of(axis: H.Axis) -> str:
    c = axis.column
    at = f"least(floor(({c} - {d(axis.low)}) / {d(axis.width)}), {axis.bins - 1})::bigint"
    return f"case when {c} >= {d(axis.low)} and {c} <= {d(axis.high)} then {at} end"


def _rounded_edges(df, n):
    return df.withColumns({f"edge_{i}": F.round(f"edge_{i}", 6) for i in range(n)})


@register(f"""
with b as (select {bin_of(VALUES)} as bin_0 from events),
g as (select unnest(range(50))::bigint as bin_0),
c as (select g.bin_0, count(b.bin_0) as n from g left join b using (bin_0) group by 1),
x as (select bin_0, n + {geometric('count', d(2.0), 'bin_0')} as "count" from c)
select bin_0, "count", round(bin_0 * {d(10)}, 6) as edge_0,
       round("count" / (select count(*)::double from orders), 9) as frequency from x
""")
def dp_histogram(spark, folder):
    n = table(spark, folder, "orders").count()
    counts = H.dp_histogram(table(spark, folder, "events"), "value", 0, 500, 50, 0.5, NOISE, n=n)
    return _rounded_edges(counts, 1).withColumn("frequency", F.round("frequency", 9))


def _grid_sql(*axes: H.Axis) -> str:
    names = [f"bin_{i}" for i in range(len(axes))]
    bins = ", ".join(f"{bin_of(a)} as {n}" for a, n in zip(axes, names))
    grids = ", ".join(f"(select unnest(range({a.bins}))::bigint as {n}) as g{n}" for a, n in zip(axes, names))
    edges = ", ".join(
        f"round({d(a.low)} + {n} * {d(a.width)}, 6) as edge_{i}" for i, (a, n) in enumerate(zip(axes, names))
    )
    joined = ", ".join(names)
    noise = geometric("count", d(1.0), *names)
    return f"""
with b as (select {bins}, 1 as one from lineitem),
g as (select * from {grids}),
c as (select {joined}, count(one) as n from g left join b using ({joined}) group by {joined})
select {joined}, n + {noise} as "count", {edges} from c"""


@register(_grid_sql(QUANTITY, DISCOUNT))
def dp_histogram2d(spark, folder):
    counts = H.dp_histogram2d(table(spark, folder, "lineitem"), QUANTITY, DISCOUNT, 1.0, NOISE)
    return _rounded_edges(counts, 2)


@register(_grid_sql(QUANTITY, DISCOUNT, TAX))
def dp_histogramdd(spark, folder):
    counts = H.dp_histogramdd(table(spark, folder, "lineitem"), [QUANTITY, DISCOUNT, TAX], 1.0, NOISE)
    return _rounded_edges(counts, 3)


DAY = H.Axis("o_day", 0, 4000, 40)
BUYER = PrivacyUnit("o_custkey", partitions=4, rows=1, row_key=("o_orderkey",), seed=SEED, algorithm="md5")
_COARSE = H.Axis("o_totalprice", 0, 500000, 5)
_YEARS = H.Axis("o_day", DAY.low, DAY.high, 7)


@register(f"""
with o as (select o_custkey, {bin_of(_COARSE)} as bin_0, {bin_of(_YEARS)} as bin_1
           from (select *, date_diff('day', date '1992-01-01', o_orderdate::date) as o_day from orders)),
p as (select o_custkey, bin_0, bin_1, row_number() over (partition by o_custkey
        order by {h52(SEED, 'o_custkey', 'bin_0', 'bin_1')}, bin_0, bin_1) as pn
      from (select distinct o_custkey, bin_0, bin_1 from o where bin_0 is not null and bin_1 is not null)),
c as (select bin_0, bin_1, count(*) as n from p where pn <= 4 group by 1, 2),
x as (select bin_0, bin_1, n + {laplace('noisy_ids', d(2.0), 'bin_0', 'bin_1')} as noisy_ids from c)
select bin_0, bin_1, round(noisy_ids, 6) as noisy_ids from x where noisy_ids >= {d(selection_threshold(2.0, 1e-5, 4))}
""")
def dp_sparse_histogram(spark, folder):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    orders = table(spark, folder, "orders").select("o_custkey", "o_totalprice", day.alias("o_day"))
    counts = H.dp_sparse_histogram(orders, [_COARSE, _YEARS], BUYER, 2.0, 1e-5, NOISE)
    return counts.withColumn("noisy_ids", F.round("noisy_ids", 6))


def quantile_sql(axis: H.Axis, source: str, quantiles: list[float], epsilon: float, group: str | None, keys: str | None) -> str:
    by = f"{group}, " if group else ""
    key = [group] if group else []
    qs = "[" + ", ".join(d(q) for q in quantiles) + "]"
    share = epsilon / len(quantiles)
    gumbel = u("gumbel", 1, *key, "printf('%.6f', q)", "bin_0")
    inside = u("inside", 1, *key, "printf('%.6f', q)")
    over = f"partition by {group}" if group else ""
    grid = f"select {by} unnest(range({axis.bins}))::bigint as bin_0" + (f" from ({keys})" if keys else "")
    return f"""
with b as (select {by} {bin_of(axis)} as bin_0, 1 as one from {source}),
g as ({grid}),
c as (select {by} bin_0, count(one) as n from g left join b using ({by} bin_0) group by {by} bin_0),
r as (select {by} bin_0, sum(n) over ({over} order by bin_0) - n / {d(2)} as rank, sum(n) over ({over}) as total from c),
s as (select {by} bin_0, q, {d(share / 2)} * (-abs(rank - q * total)) + {d(math.log(axis.width))}
             - ln(-ln({gumbel})) as utility from r, (select unnest({qs}) as q)),
best as (select {by} q, arg_max(bin_0, utility) as bin_0 from s group by {by} q)
select {by} q as quantile, round({d(axis.low)} + (bin_0 + {inside}) * {d(axis.width)}, 6) as value from best"""


@register(quantile_sql(VALUES, "events", [0.1, 0.5, 0.9], 3.0, None, None))
def dp_quantiles(spark, folder):
    answer = H.dp_quantiles(table(spark, folder, "events"), VALUES, [0.1, 0.5, 0.9], 3.0, NOISE)
    return answer.withColumn("value", F.round("value", 6))


_MEDIAN = H.Axis("o_totalprice", 0, 500000, 200)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register(quantile_sql(_MEDIAN, "orders", [0.5], 1.0, "o_orderpriority", f"select unnest({PRIORITIES}) as o_orderpriority"))
def dp_median_by_group(spark, folder):
    orders = table(spark, folder, "orders")
    keys = declared_keys(spark, {"o_orderpriority": PRIORITIES})
    answer = H.dp_median(orders, _MEDIAN, 1.0, NOISE, by=["o_orderpriority"], keyset=keys)
    return answer.withColumn("value", F.round("value", 6))


@register(quantile_sql(H.Axis("c_acctbal", -1000, 10000, 110), "customer", [0.25, 0.75], 1.0, None, None))
def dp_percentiles(spark, folder):
    axis = H.Axis("c_acctbal", -1000, 10000, 110)
    answer = H.dp_percentiles(table(spark, folder, "customer"), axis, [25, 75], 1.0, NOISE)
    return answer.withColumn("value", F.round("value", 6))
