"""The error study: trials, summaries, comparisons."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hushframe.plans import evaluation as E
from hushframe.sources.tables import dataset_features
from workload.registry import register, table
from workload.sources import DATASET_SQL, dataset_name
from workload.sql import NOISE, clamp, d, geometric, laplace

LOW, HIGH, GRID, ITERATIONS = 0.0, 60.0, 0.01, 3
HALF, MIDDLE = (HIGH - LOW) / 2, (LOW + HIGH) / 2
STEPS = math.ceil(HIGH / GRID)
KEY = ["dataset", "query", "mechanism", "epsilon", "iteration"]


def _lap(label: str, sensitivity: str, share: int = 1) -> str:
    return laplace(label, f"({sensitivity}) / (epsilon / {d(share)})", *KEY)


def _geo(label: str, sensitivity: float, share: int = 1) -> str:
    return geometric(label, f"{d(sensitivity)} / (epsilon / {d(share)})", *KEY)


def _size(share: int) -> str:
    return f"greatest(n + {_geo('n', 1, share)}, {d(1)})"


def _variance_sql() -> str:
    size = _size(3)
    shift = f"((m1 + {_lap('m1', d(HALF), 3)}) / {size})"
    spread = f"(m2 + {_lap('m2', d(HALF * HALF), 3)}) / {size} - {shift} * {shift}"
    clipped = f"greatest(least({spread}, {d(HALF * HALF)}), {d(0)})"
    return f"{clipped} * {size} / greatest({size} - {d(1)}, {d(1)})"


_ANSWERS = {
    ("COUNT", "geometric"): f"n + {_geo('n', 1)}",
    ("COUNT", "laplace"): f"n + {_lap('n', d(1))}",
    ("SUM", "geometric"): f"(grid_sum + {_geo('sum', STEPS)}) * {d(GRID)}",
    ("SUM", "laplace"): f"bounded_sum + {_lap('sum', d(HIGH))}",
    ("MEAN", "public_size"): f"m1 / n + {d(MIDDLE)} + {_lap('mean', f'{d(HIGH - LOW)} / n')}",
    ("MEAN", "noisy_size"): f"greatest(least({d(MIDDLE)} + (m1 + {_lap('m1', d(HALF), 2)}) / {_size(2)}, {d(HIGH)}), {d(LOW)})",
    ("VARIANCE", "public_size"): f"(m2 - m1 * (m1 / n)) / greatest(n - 1, {d(1)}) + {_lap('variance', f'{d((HIGH - LOW) ** 2)} / n')}",
    ("VARIANCE", "noisy_size"): _variance_sql(),
}
_CASES = " ".join(f"when query = '{q}' and mechanism = '{m}' then {sql}" for (q, m), sql in _ANSWERS.items())
_PAIRS = ", ".join(f"{{'query': '{q}', 'mechanism': '{m}'}}" for q, m in E.TRIALS)
_EPSILONS = ", ".join(d(e) for e in E.EPSILONS)

TRIALS_SQL = f"""
v as (select {DATASET_SQL} as dataset, l_quantity as raw, {clamp('l_quantity', LOW, HIGH)} as x from lineitem),
m as (select dataset, count(x)::double as n, sum(raw) as true_sum, avg(raw) as true_mean, var_samp(raw) as true_variance,
        sum(x) as bounded_sum, sum(round(x / {d(GRID)})) as grid_sum, sum(x - {d(MIDDLE)}) as m1,
        sum((x - {d(MIDDLE)}) * (x - {d(MIDDLE)})) as m2 from v group by 1),
t as (select unnest([{_PAIRS}], recursive := true)),
g as (select m.*, t.*, e.epsilon, i.iteration::int as iteration from m, t,
        (select unnest([{_EPSILONS}]) as epsilon) e, (select unnest(range(1, {ITERATIONS + 1})) as iteration) i),
a as (select dataset, query, mechanism, epsilon, iteration, n,
        case query when 'COUNT' then n when 'SUM' then true_sum when 'MEAN' then true_mean else true_variance end as truth,
        case {_CASES} end as answer from g),
trials as (select *, abs(truth - answer) as error, abs(truth - answer) / nullif(abs(truth), 0) as relative_error,
        abs(truth - answer) / n as scaled_error from a)"""

SUMMARY_SQL = """
summary as (select dataset, query, mechanism, epsilon, count(*) as trials,
  avg(error) as mean_error, stddev_pop(error) as stdev_error, avg(relative_error) as mean_relative_error,
  stddev_pop(relative_error) as stdev_relative_error, avg(scaled_error) as mean_scaled_error,
  stddev_pop(scaled_error) as stdev_scaled_error from trials group by 1, 2, 3, 4)"""


def _trials(spark, folder):
    rows = table(spark, folder, "lineitem").select(dataset_name().alias("dataset"), F.col("l_quantity").alias("values"))
    return E.run_trials(rows, "dataset", "values", LOW, HIGH, NOISE, grid=GRID, iterations=ITERATIONS)


def _rounded(df, digits, columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@register(f"""
with {TRIALS_SQL}
select dataset, query, mechanism, epsilon, iteration, n::bigint as n, round(truth, 5) as truth, round(answer, 5) as answer,
       round(error, 5) as error, round(relative_error, 7) as relative_error, round(scaled_error, 7) as scaled_error from trials
""")
def run_trials(spark, folder):
    rounded = _rounded(_trials(spark, folder), 5, ["truth", "answer", "error"])
    return _rounded(rounded, 7, ["relative_error", "scaled_error"])


ERRORS = [f"{p}_{e}" for e in ("error", "relative_error", "scaled_error") for p in ("mean", "stdev")]


@register(f"""
with {TRIALS_SQL}, {SUMMARY_SQL}
select dataset, query, mechanism, epsilon, trials, {', '.join(f'round({c}, 5) as {c}' for c in ERRORS)} from summary
""")
def summarise_trials(spark, folder):
    return _rounded(E.summarise_trials(_trials(spark, folder)), 5, ERRORS)


@register(f"""
with {TRIALS_SQL}, {SUMMARY_SQL},
p as (select query, epsilon, mechanism, avg(mean_error) as e from summary group by all)
select query, epsilon, {', '.join(f"round(max(case when mechanism = '{m}' then e end), 5) as {m}" for m in E.MECHANISMS)},
       arg_min(mechanism, e) as best from p group by 1, 2
""")
def compare_mechanisms(spark, folder):
    compared = E.compare_mechanisms(E.summarise_trials(_trials(spark, folder)))
    return _rounded(compared, 5, E.MECHANISMS)


@register(f"""
with {TRIALS_SQL}, {SUMMARY_SQL}
select regexp_extract(dataset, 'data_(\\d+)_(\\d+)_(\\d+)', 1)::bigint as dataset_size,
       regexp_extract(dataset, 'data_(\\d+)_(\\d+)_(\\d+)', 2)::int as dataset_scale,
       regexp_extract(dataset, 'data_(\\d+)_(\\d+)_(\\d+)', 3)::int as dataset_skew, query, mechanism,
       round(avg(mean_error), 5) as mean_error, round(avg(mean_relative_error), 5) as mean_relative_error,
       round(avg(mean_scaled_error), 5) as mean_scaled_error, count(*) as settings
from summary group by 1, 2, 3, 4, 5
""")
def error_by_feature(spark, folder):
    features = dataset_features()
    summary = E.summarise_trials(_trials(spark, folder)).withColumns(features)
    errors = E.error_by_feature(summary, list(features))
    return _rounded(errors, 5, ["mean_error", "mean_relative_error", "mean_scaled_error"])
