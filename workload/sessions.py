"""Sessions that pay for every kind of statistic, and releases with operating-system randomness."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions.calibration import selection_threshold
from hushframe.functions.noise import SecureNoise
from hushframe.operators import histograms as H
from hushframe.operators import private as P
from hushframe.operators.bounding import PrivacyUnit
from hushframe.operators.keysets import declared_keys
from hushframe.plans.materialise import new_path
from hushframe.plans.session import BudgetExceeded, PrivacySession, Query
from workload.grids import VALUES, bin_of, quantile_sql
from workload.registry import register, table
from workload.sql import NOISE, SEED, clamp, d, geometric, h52, laplace

CUSTOMER = PrivacyUnit("o_custkey", partitions=3, row_key=("o_orderkey",), seed=SEED, algorithm="md5")


@register(f"""
with o as (select o_custkey, o_orderkey, year(o_orderdate) as o_year, o_totalprice from orders),
r as (select *, row_number() over (partition by o_custkey, o_year order by {h52(SEED, 'o_orderkey')}, o_orderkey) as rn from o),
p as (select o_custkey, o_year, row_number() over (partition by o_custkey
        order by {h52(SEED, 'o_custkey', 'o_year')}, o_year) as pn from (select distinct o_custkey, o_year from o)),
m as (select o_year, count(*) as n, sum({clamp('o_totalprice', 0, 300000)}::decimal(18, 2))::double as s
      from r join p using (o_custkey, o_year) where rn <= 1 and pn <= 3 group by 1),
x as (select o_year, n + {geometric('count_rows', d(3 / 0.5), 'o_year')} as "count",
             s + {laplace('sum_sum', d(3 * 300000 / 0.5), 'o_year')} as "sum",
             n + {laplace('selected_ids', d(3.0), 'o_year')} as ids from m)
select o_year, "count", round("sum", 4) as "sum", 1.0::double as remaining, 1e-3::double as remaining_delta
from x where ids >= {d(selection_threshold(1.0, 1e-3, 3))}
""")
def session_found_keys(spark, folder):
    """An (epsilon, delta) session pays for keys that are found in the private rows."""
    session = PrivacySession.from_dataframe(
        table(spark, folder, "orders"), "orders", 3.0, measure="approx", delta=2e-3, unit=CUSTOMER, noise=NOISE
    )
    query = Query("orders").with_column("o_year", "year(o_orderdate)").group_by_found(["o_year"], 1e-3)
    answer = session.evaluate(query.aggregate(["count", "sum"], "o_totalprice", 0, 300000), 2.0)
    return answer.select(
        "o_year", "count", F.round("sum", 4).alias("sum"), F.lit(session.remaining).alias("remaining"),
        F.round(F.lit(session.remaining_delta), 9).alias("remaining_delta"),
    )


@register(f"""
with b as (select {bin_of(VALUES)} as bin_0 from events where event_type = 'purchase'),
g as (select unnest(range(50))::bigint as bin_0),
c as (select g.bin_0, count(b.bin_0) as n from g left join b using (bin_0) group by 1)
select bin_0, n + {geometric('count', d(4.0), 'bin_0')} as "count", round(bin_0 * {d(10)}, 6) as edge_0 from c
""")
def session_histogram(spark, folder):
    session = PrivacySession.from_dataframe(table(spark, folder, "events"), "events", 1.0, noise=NOISE)
    answer = session.evaluate(Query("events").filter("event_type = 'purchase'").histogram(VALUES), 0.25)
    return answer.withColumn("edge_0", F.round("edge_0", 6))


@register(quantile_sql(VALUES, "(select * from events where event_type <> 'error')", [0.25, 0.75], 2.0, None, None))
def session_quantiles(spark, folder):
    session = PrivacySession.from_dataframe(table(spark, folder, "events"), "events", 2.0, noise=NOISE)
    answer = session.evaluate(Query("events").filter("event_type <> 'error'").quantiles(VALUES, [0.25, 0.75]), 2.0)
    return answer.withColumn("value", F.round("value", 6))


@register(f"""
with k as (select unnest(['A', 'N', 'R']) as l_returnflag),
m as (select l_returnflag, count(l_orderkey) as n, sum({clamp('l_quantity', 0, 50)}) as s,
             sum({clamp('l_quantity', 0, 50)} - {d(25)}) as m1 from k left join lineitem using (l_returnflag) group by 1)
select l_returnflag, n + {geometric('count_rows', d(2.0), 'l_returnflag')} as "count",
       round(s + {laplace('sum_sum', d(50 / 0.25), 'l_returnflag')}, 6) as "sum",
       round(greatest(least({d(25)} + (m1 + {laplace('mean_m1', d(25 / 0.125), 'l_returnflag')})
         / greatest((n + {geometric('mean_n', d(1 / 0.125), 'l_returnflag')})::double, {d(1)}), {d(50)}), {d(0)}), 6) as mean
from m
""")
def session_aggregate(spark, folder):
    """Several statistics of one query share a pass and, by weight, its budget."""
    session = PrivacySession.from_dataframe(table(spark, folder, "lineitem"), "lines", 1.0, noise=NOISE)
    query = Query("lines").group_by(declared_keys(spark, {"l_returnflag": ["A", "N", "R"]}))
    answer = session.evaluate(query.aggregate(["count", "sum", "mean"], "l_quantity", 0, 50, {"count": 2.0}), 1.0)
    return answer.withColumns({"sum": F.round("sum", 6), "mean": F.round("mean", 6)})


@register(f"""
select count(*) + {geometric('count_rows', d(2.0))} as "count", 1.25::double as remaining, 2 as spends
from customer where c_acctbal > 0
""")
def session_resumed(spark, folder):
    """A session that starts again under its name finds in the ledger what it has spent."""
    customers, path = table(spark, folder, "customer"), new_path(spark, "ledger")
    options = {"noise": NOISE, "name": "customers", "ledger_path": path}
    PrivacySession.from_dataframe(customers, "customers", 2.0, **options).evaluate(Query("customers").count(), 0.25)
    session = PrivacySession.from_dataframe(customers, "customers", 2.0, **options)
    answer = session.evaluate(Query("customers").filter("c_acctbal > 0").count(), 0.5)
    return answer.withColumns({"remaining": F.lit(session.remaining), "spends": F.lit(len(session))})


@register(f"""
with k as (select unnest(['A', 'N', 'R']) as l_returnflag),
c as (select l_returnflag, count(l_orderkey) as n from k left join lineitem using (l_returnflag) group by 1)
select l_returnflag, n + {geometric('count_rows', d(1 / 0.75), 'l_returnflag')} as "count",
       0.25::double as left_to_first, 0.25::double as left_to_second, true as second_refused, 1 as spends
from c
""")
def session_two_writers(spark, folder):
    """Two open sessions of one name share a limit: what one has spent, the other cannot spend again."""
    lines, path = table(spark, folder, "lineitem"), new_path(spark, "ledger")
    options = {"noise": NOISE, "name": "lines", "ledger_path": path}
    first, second = (PrivacySession.from_dataframe(lines, "lines", 1.0, **options) for _ in range(2))
    query = Query("lines").group_by(declared_keys(spark, {"l_returnflag": ["A", "N", "R"]})).count()
    answer = first.evaluate(query, 0.75)
    try:
        second.evaluate(query, 0.75)
        refused = False
    except BudgetExceeded:
        refused = True
    return answer.withColumns({
        "left_to_first": F.lit(first.remaining), "left_to_second": F.lit(second.remaining),
        "second_refused": F.lit(refused), "spends": F.lit(len(second)),
    })


#: So large that noise of whole numbers is zero and other noise vanishes in rounding.
EXACT = 1e6


@register("""
with k as (select unnest(['A', 'N', 'R']) as l_returnflag)
select l_returnflag, count(l_orderkey) as "count" from k left join lineitem using (l_returnflag) group by 1
""")
def secure_count(spark, folder):
    keys = declared_keys(spark, {"l_returnflag": ["A", "N", "R"]})
    return P.dp_count(table(spark, folder, "lineitem"), EXACT, SecureNoise(), by=["l_returnflag"], keyset=keys)


@register(f"""
with b as (select {bin_of(VALUES)} as bin_0 from events),
g as (select unnest(range(50))::bigint as bin_0)
select g.bin_0, count(b.bin_0) as "count", round(g.bin_0 * {d(10)}, 6) as edge_0 from g left join b using (bin_0) group by 1
""")
def secure_histogram(spark, folder):
    answer = H.dp_histogramdd(table(spark, folder, "events"), [VALUES], EXACT, SecureNoise())
    return answer.withColumn("edge_0", F.round("edge_0", 6))


@register("""
with c as (select floor(o_totalprice / 2500)::bigint as price, count(distinct o_custkey) as n from orders group by 1)
select price, n::double as noisy_ids from c where n > 1
""")
def secure_found_keys(spark, folder):
    """Only what several customers share is released; no customer has as many prices as are allowed."""
    orders = table(spark, folder, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 2500).alias("price"))
    unit = PrivacyUnit("o_custkey", partitions=1000)
    found = P.select_partitions(orders, unit, ["price"], EXACT, 1e-9, SecureNoise())
    return found.withColumn("noisy_ids", F.round("noisy_ids", 0))
