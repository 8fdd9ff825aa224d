"""Noise, calibration, budgets, sessions, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import calibration as C
from hushframe.functions.scalars import label
from hushframe.operators.bounding import PrivacyUnit
from hushframe.operators.keysets import declared_keys
from hushframe.plans import composition as tight
from hushframe.plans import ledger as L
from hushframe.plans.session import PrivacySession, Query
from workload.aggregates import SEGMENTS, discrete_gaussian_sql
from workload.registry import register, table
from workload.sql import NOISE, clamp, d, gaussian, geometric, h52, laplace

_PER_CUSTOMER = "select o_custkey, count(*) as n from orders group by 1"


def _noisy(mechanism, spark, folder):
    counts = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    noisy = F.col("n") + NOISE.noise(mechanism, "n", F.lit(9.0), ["o_custkey"])
    return counts.select("o_custkey", noisy.alias("noisy"))


@register(f"with c as ({_PER_CUSTOMER}) select o_custkey, round(n + {laplace('n', d(9.0), 'o_custkey')}, 6) as noisy from c")
def noise_laplace(spark, folder):
    return _noisy("laplace", spark, folder).withColumn("noisy", F.round("noisy", 6))


@register(f"with c as ({_PER_CUSTOMER}) select o_custkey, n + {geometric('n', d(9.0), 'o_custkey')} as noisy from c")
def noise_geometric(spark, folder):
    return _noisy("geometric", spark, folder)


@register(f"with c as ({_PER_CUSTOMER}) select o_custkey, round(n + {gaussian('n', d(9.0), 'o_custkey')}, 6) as noisy from c")
def noise_gaussian(spark, folder):
    return _noisy("gaussian", spark, folder).withColumn("noisy", F.round("noisy", 6))


@register(f"select * from {discrete_gaussian_sql('(' + _PER_CUSTOMER + ')', 'o_custkey', 'n', 'n', 9.0, 'o_custkey')}")
def noise_discrete_gaussian(spark, folder):
    return _noisy("discrete_gaussian", spark, folder)


@register("""
select l_orderkey, l_linenumber, l_partkey, l_linenumber as d_in, l_quantity / 10 as d_out,
       case when l_returnflag = 'A' then 'pure' else 'zcdp' end as measure,
       round(case when l_returnflag = 'A' then l_linenumber / (l_quantity / 10)
                  else l_linenumber * l_linenumber / (2 * (l_quantity / 10)) end, 9) as scale
from lineitem
""")
def noise_scales(spark, folder):
    plan = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").alias("d_in"),
        (F.col("l_quantity") / 10).alias("d_out"),
        F.when(F.col("l_returnflag") == "A", "pure").otherwise("zcdp").alias("measure"),
    )
    return plan.withColumn("scale", F.round(C.noise_scale("d_in", "d_out", F.col("measure")), 9))


@register("""
with p as (select l_orderkey, l_linenumber, l_partkey, l_quantity as scale,
             case l_returnflag when 'A' then 'laplace' when 'N' then 'geometric' else 'discrete_gaussian' end as mechanism
           from lineitem),
x as (select *, case when mechanism = 'discrete_gaussian' then l_linenumber * l_linenumber / (2 * scale)
                     else l_linenumber / scale end as loss from p)
select l_orderkey, l_linenumber, l_partkey, mechanism, scale, round(loss, 9) as loss, loss <= 0.5 as satisfied from x
""")
def privacy_losses(spark, folder):
    """Loss for groups of as many units as the line number says."""
    mechanism = F.when(F.col("l_returnflag") == "A", "laplace").when(F.col("l_returnflag") == "N", "geometric")
    plan = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("scale"),
        mechanism.otherwise("discrete_gaussian").alias("mechanism"),
    )
    loss = C.privacy_loss("mechanism", "scale", "l_linenumber")
    lost = plan.withColumn("loss", loss).withColumn("satisfied", C.satisfied("loss", 0.5))
    return lost.withColumn("loss", F.round("loss", 9))


# One spend per event: the session is the user, the partition is the event type.
SPENDS = """spends as (
  select user_id::varchar as session, event_type as "partition", round(value / 1000, 5) as epsilon,
         case when event_type = 'purchase' then 1e-7 else 0 end::double as delta,
         case when event_type = 'click' then round(value / 5000, 5) end as rho, ts from events)"""


def spends(spark, folder):
    events = table(spark, folder, "events")
    return events.select(
        F.col("user_id").cast("string").alias("session"),
        F.col("event_type").alias("partition"),
        F.lit("count").alias("query"),
        F.lit("laplace").alias("mechanism"),
        F.round(F.col("value") / 1000, 5).alias("epsilon"),
        F.when(F.col("event_type") == "purchase", 1e-7).otherwise(0.0).alias("delta"),
        F.when(F.col("event_type") == "click", F.round(F.col("value") / 5000, 5)).alias("rho"),
        "ts",
        "event_id",
    )


@register(f"""
with {SPENDS}
select session, sum(epsilon::decimal(18, 12))::double as epsilon, round(sum(delta), 12) as delta, count(*) as spends,
       coalesce(sum(rho::decimal(18, 12)), 0)::double as rho,
       (5 - sum(epsilon::decimal(18, 12)))::double as remaining, sum(epsilon::decimal(18, 12)) > 5 as over_limit
from spends group by 1
""")
def ledger_totals(spark, folder):
    return L.totals(spends(spark, folder), 5.0).withColumn("delta", F.round("delta", 12))


@register(f"""
with {SPENDS},
r as (select session, ts, sum(epsilon::decimal(18, 12)) over (partition by session order by ts) as upto from spends),
f as (select session, min(ts) as ts from r where upto > 2 group by 1)
select distinct session, ts, upto::double as epsilon from r join f using (session, ts)
""")
def first_overrun(spark, folder):
    return L.first_overrun(spends(spark, folder), 2.0)


def without_delta(spark, folder):
    """The same spends without a delta, so that zCDP can express all of them."""
    return spends(spark, folder).withColumn("delta", F.lit(0.0))


# Rho of each spend: its own, or half the square of its epsilon, rounded up to twelve decimals.
_RHO = "coalesce(rho, epsilon * epsilon / 2)"
RHO = (
    f"({_RHO}::decimal(28, 12) + case when {_RHO}::decimal(28, 12)::double < {_RHO} then 0.000000000001 else 0 end)::decimal(28, 12)"
)


@register(f"""
with {SPENDS}
select session, sum(epsilon::decimal(28, 12))::double as epsilon, 0::double as delta, count(*) as spends,
       sum({RHO})::double as rho, (2 - sum({RHO}))::double as remaining, sum({RHO}) > 2 as over_limit
from spends group by 1
""")
def zcdp_ledger_totals(spark, folder):
    return L.totals(without_delta(spark, folder), 2.0, "zcdp")


@register(f"""
with {SPENDS},
r as (select session, ts, sum({RHO}) over (partition by session order by ts) as upto from spends),
f as (select session, min(ts) as ts from r where upto > 1 group by 1)
select distinct session, ts, upto::double as rho from r join f using (session, ts)
""")
def zcdp_first_overrun(spark, folder):
    return L.first_overrun(without_delta(spark, folder), 1.0, "zcdp")


@register(f"""
with {SPENDS}, p as (select session, "partition", sum({RHO}) as r from spends group by 1, 2)
select session, max(r)::double as rho, count(*) as partitions from p group by 1
""")
def mixed_ledger_parallel(spark, folder):
    """Pure and zCDP spends in one ledger, on disjoint partitions."""
    return L.parallel_compose(without_delta(spark, folder), "zcdp")


@register(f"""
with {SPENDS}
select session, sum(epsilon::decimal(28, 12))::double as epsilon, round(sum(delta), 12) as delta, count(*) as spends,
       coalesce(sum(rho::decimal(28, 12)), 0)::double as rho, 'infinity'::double as remaining, false as over_limit
from spends group by 1
""")
def unlimited_ledger_totals(spark, folder):
    return L.totals(spends(spark, folder), float("inf")).withColumn("delta", F.round("delta", 12))


@register(f"""
with {SPENDS},
s as (select session, sum(epsilon) as e, sum(epsilon * epsilon) as q, count(*) as spends, sum(ln(1 - delta)) as safe,
             sum(epsilon * (exp(epsilon) - 1) / (exp(epsilon) + 1)) as a from spends group by 1)
select session, spends,
       round(least(e, a + sqrt(2 * q * ln(1 / 1e-3)), a + sqrt(2 * q * ln(exp(1) + sqrt(q) / 1e-3))), 9) as epsilon,
       round(1 - (1 - 1e-3) * exp(safe), 12) as delta from s
""")
def compose_advanced(spark, folder):
    composed = L.compose_advanced(spends(spark, folder), 1e-3)
    return composed.withColumns({"epsilon": F.round("epsilon", 9), "delta": F.round("delta", 12)})


@register()
def compose_tight(spark, folder):
    """Without SQL, which has no Fourier transform; tested against exact sums and integrals."""
    composed = tight.compose_tight(spends(spark, folder), 1e-3)
    return composed.withColumns({"epsilon": F.round("epsilon", 9), "delta": F.round("delta", 12)})


@register(f"""
with {SPENDS}, p as (select session, "partition", sum(epsilon::decimal(18, 12)) as e from spends group by 1, 2)
select session, max(e)::double as epsilon, count(*) as partitions from p group by 1
""")
def parallel_compose(spark, folder):
    return L.parallel_compose(spends(spark, folder))


@register("""
with s as (select event_id, round(value / 1000, 5) as epsilon,
             case when event_type = 'purchase' then 1e-7::double else 0::double end as delta,
             case when event_type = 'click' then round(value / 5000, 5) end as rho from events)
select event_id, case when delta = 0 then round(coalesce(rho, epsilon * epsilon / 2), 9) end as zcdp_rho,
       round(case when rho is not null then rho + 2 * sqrt(rho * ln(1 / 1e-6)) else epsilon end, 9) as approx_epsilon,
       (case when rho is not null then 1e-6 else 0 end + delta)::double as approx_delta from s
""")
def convert_spends(spark, folder):
    converted = L.convert_spends(spends(spark, folder), 1e-6)
    return converted.select(
        "event_id", F.round("zcdp_rho", 9).alias("zcdp_rho"),
        F.round("approx_epsilon", 9).alias("approx_epsilon"), "approx_delta",
    )


@register("""
with t as (select user_id, sum(value::decimal(18, 12))::double as w from events group by 1)
select event_id, user_id::varchar as session, round(2.0::double * value / w, 12) as epsilon
from events join t using (user_id)
""")
def split_budget(spark, folder):
    plan = table(spark, folder, "events").select(
        "event_id", F.col("user_id").cast("string").alias("session"), F.col("value").alias("weight")
    )
    shares = L.split_budget(plan, 2.0)
    return shares.select("event_id", "session", F.round("epsilon", 12).alias("epsilon"))


@register(f"""
with c as (select count(*) + {geometric('count_rows', d(1.0))} as v from events where event_type in ('click', 'error')),
m as (select count(x) as n, sum(x - {d(250)}) as m1 from (select {clamp('value', 0, 500)} as x from events))
select 'count' as query, v::double as answer, 1.5::double as remaining from c
union all
select 'mean', round(greatest(least({d(250)} + (m1 + {laplace('mean_m1', d(1000.0))})
       / greatest((n + {geometric('mean_n', d(4.0))})::double, {d(1)}), {d(500)}), {d(0)}), 6), 1.5::double from m
""")
def budget_session(spark, folder):
    """Two answers paid from a session of 3; the second charge is half of the first."""
    session = PrivacySession.from_dataframe(table(spark, folder, "events"), "events", 3.0, noise=NOISE)
    asked = {
        "count": Query("events").filter("event_type IN ('click', 'error')").count(),
        "mean": Query("events").average("value", 0, 500),
    }
    answers = session.evaluate_all(asked, 1.5, {"count": 2.0, "mean": 1.0})
    rows = [
        answers[name].select(
            F.lit(name).alias("query"), F.round(F.col(name).cast("double"), 6).alias("answer"),
            F.lit(session.remaining).alias("remaining"),
        )
        for name in asked
    ]
    return rows[0].unionAll(rows[1])


_SESSION_SIGMA = 1.0 / (2 * 0.02)


@register(f"""
with g as (select n_nationkey as c_nationkey, count(c_custkey) as n
           from nation left join customer on c_nationkey = n_nationkey group by 1),
h as (select c_nationkey, case when noisy < 60 then 'true' else 'false' end as under from
  {discrete_gaussian_sql('g', 'c_nationkey', 'n', 'count_rows', _SESSION_SIGMA, 'c_nationkey')}),
small as (select n_nationkey as c_nationkey, count(c_custkey) as n from nation left join
  (select customer.* from customer join h using (c_nationkey) where under = 'true') on c_nationkey = n_nationkey group by 1),
large as (select seg as c_mktsegment, count(c_custkey) as n from
  (select unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) as seg) left join
  (select customer.* from customer join h using (c_nationkey) where under = 'false') on c_mktsegment = seg group by 1)
select 'small' as part, c_nationkey::varchar as key, noisy as "count", 0.0::double as remaining from
  {discrete_gaussian_sql('small', 'c_nationkey', 'n', 'count_rows', 1.0 / (2 * 0.18), 'c_nationkey')}
union all
select 'large', c_mktsegment, noisy, 0.0::double from
  {discrete_gaussian_sql('large', 'c_mktsegment', 'n', 'count_rows', 1.0 / (2 * 0.18), 'c_mktsegment')}
""")
def session_two_phases(spark, folder):
    """The steps of a two-phase query one by one: release, label, join back as a view, split, release again."""
    session = PrivacySession.from_dataframe(
        table(spark, folder, "customer"), "customer", 0.2, measure="zcdp", noise=NOISE
    )
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    segments = declared_keys(spark, {"c_mktsegment": SEGMENTS})
    counts = session.evaluate(Query("customer").group_by(nations).count(), 0.02)
    labelled = counts.select("c_nationkey", label("count < 60", "true", "false").alias("under"))
    view = f"labelled_{id(session)}"
    session.create_view(Query("customer").join_public(labelled, ["c_nationkey"]), view)
    parts = session.partition_and_spend(view, "under", {"small": "true", "large": "false"}, 0.18)
    small = parts["small"].evaluate(Query(view).group_by(nations).count(), 0.18)
    large = parts["large"].evaluate(Query(view).group_by(segments).count(), 0.18)
    left = F.round(F.lit(session.remaining), 9).alias("remaining")
    return small.select(
        F.lit("small").alias("part"), F.col("c_nationkey").cast("string").alias("key"), "count", left
    ).unionAll(large.select(F.lit("large").alias("part"), F.col("c_mktsegment").alias("key"), "count", left))


@register(f"""
with k as (select r_regionkey as n_regionkey from region),
c as (select n_regionkey, count(c_custkey) as n from k left join
        (select * from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0) using (n_regionkey) group by 1)
select n_regionkey, n + {geometric('count_rows', d(2.0), 'n_regionkey')} as "count" from c
""")
def session_view(spark, folder):
    """A view joined with public data, then a grouped count on the view."""
    session = PrivacySession.from_dataframe(table(spark, folder, "customer"), "customer", 1.0, noise=NOISE)
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    session.create_view(Query("customer").join_public(nations, ["c_nationkey"]), "customer_region")
    regions = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"))
    return session.evaluate(Query("customer_region").filter("c_acctbal > 0").group_by(regions).count(), 0.5)


@register(f"""
select 'building' as part, count(*) + {geometric('count_rows', d(2.0))} as "count" from customer where c_mktsegment = 'BUILDING'
union all
select 'machinery', count(*) + {geometric('count_rows', d(2.0))} from customer where c_mktsegment = 'MACHINERY'
""")
def session_partition(spark, folder):
    """Disjoint children, each with the whole amount that the parent paid once."""
    parent = PrivacySession.from_dataframe(table(spark, folder, "customer"), "customer", 1.0, noise=NOISE)
    children = parent.partition_and_spend(
        "customer", "c_mktsegment", {"building": "BUILDING", "machinery": "MACHINERY"}, 0.5
    )
    parts = [
        child.evaluate(Query("customer").count(), 0.5).select(F.lit(name).alias("part"), "count")
        for name, child in children.items()
    ]
    return parts[0].unionAll(parts[1])


@register(f"""
with x as (select user_id, value, row_number() over (partition by user_id order by {h52('0', 'event_id')}, event_id) as r
           from events where value > 5)
select count(*) + {geometric('count_rows', d(1 / 0.5 * 3))} as "count" from x where r <= 3
""")
def session_select_rename(spark, folder):
    """Steps that drop, rename and replace the columns of the privacy unit: the bound still counts people."""
    unit = PrivacyUnit("user_id", rows=3, row_key=("event_id",), algorithm="md5")
    session = PrivacySession.from_dataframe(table(spark, folder, "events"), "events", 1.0, unit=unit, noise=NOISE)
    query = Query("events").filter("value > 5").rename({"user_id": "old", "event_id": "user_id"})
    return session.evaluate(query.select("user_id", "value").with_column("event_id", "value * 2").count(), 0.5)


@register(f"""
select count(*) + {geometric('count_rows', d(3 / 0.5))} as "count" from lineitem
where l_quantity >= 1
""")
def session_explode(spark, folder):
    """One row may become three, so the noise is three times as wide; here each becomes one."""
    session = PrivacySession.from_dataframe(table(spark, folder, "lineitem"), "lines", 1.0, noise=NOISE)
    query = Query("lines").explode("copy", "sequence(1, cast(least(l_quantity, 1) as int))", 3)
    return session.evaluate(query.count(), 0.5)
