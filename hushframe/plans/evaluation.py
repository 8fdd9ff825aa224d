"""How far private answers are from the truth, over budgets, datasets, statistics and mechanisms.

The exact moments of each dataset are computed once. Every trial is then a row: budgets, mechanisms and
repetitions are expanded from those moments, so the private table is not read again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.noise import SeededNoise
from hushframe.functions.scalars import check_bounds, clamp, error_columns, grid_steps

# The budgets that are compared.
EPSILONS = [
    0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09,
    0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9,
    1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0,
]

# Statistic and mechanism pairs that the job knows.
TRIALS = [
    ("COUNT", "geometric"),
    ("COUNT", "laplace"),
    ("SUM", "geometric"),
    ("SUM", "laplace"),
    ("MEAN", "public_size"),
    ("MEAN", "noisy_size"),
    ("VARIANCE", "public_size"),
    ("VARIANCE", "noisy_size"),
]
MECHANISMS = ["geometric", "laplace", "public_size", "noisy_size"]
TRIAL_KEY = ["dataset", "query", "mechanism", "epsilon"]


def unsafe_data_bounds(df: DataFrame, value: str) -> tuple[float, float]:
    """Smallest and largest value, in one job. They are private: for error studies only."""
    row = df.agg(F.min(value), F.max(value)).first()
    return float(row[0]), float(row[1])


def dataset_moments(df: DataFrame, dataset: str, value: str, low: float, high: float, grid: float) -> DataFrame:
    """One row per dataset: size, truths, and the bounded moments that noise is added to."""
    check_bounds(low, high)
    middle = (low + high) / 2.0
    x = clamp(value, low, high)
    y = x - F.lit(middle)
    return df.groupBy(F.col(dataset).alias("dataset")).agg(
        F.count(x).alias("n"),
        F.sum(value).alias("true_sum"),
        F.avg(value).alias("true_mean"),
        F.var_samp(value).alias("true_variance"),
        F.sum(x).alias("bounded_sum"),
        F.sum(grid_steps(x, grid)).cast("double").alias("grid_sum"),
        F.sum(y).alias("m1"),
        F.sum(y * y).alias("m2"),
    )


def trial_grid(
    moments: DataFrame,
    epsilons: Sequence[float] = EPSILONS,
    iterations: int = 100,
    trials: Sequence[tuple[str, str]] = TRIALS,
) -> DataFrame:
    """Every dataset x statistic x mechanism x epsilon x iteration, expanded inside the rows.

    Budgets are spread over the tasks before the repetitions are unfolded.
    """
    pairs = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(m).alias("mechanism")) for q, m in trials])
    wide = moments.select("*", F.inline(pairs))
    wide = wide.withColumn("epsilon", F.explode(F.array(*[F.lit(float(e)) for e in epsilons])))
    tasks = moments.sparkSession.sparkContext.defaultParallelism
    spread = wide.repartition(tasks, *TRIAL_KEY)
    return spread.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))


def run_trials(
    df: DataFrame,
    dataset: str,
    value: str,
    low: float,
    high: float,
    noise: SeededNoise,
    *,
    grid: float = 0.01,
    epsilons: Sequence[float] = EPSILONS,
    iterations: int = 100,
    trials: Sequence[tuple[str, str]] = TRIALS,
) -> DataFrame:
    """One noisy answer and its errors per trial."""
    moments = dataset_moments(df, dataset, value, low, high, grid)
    rows = trial_grid(moments, epsilons, iterations, trials)
    query, mechanism = F.col("query"), F.col("mechanism")
    truth = (
        F.when(query == "COUNT", F.col("n").cast("double"))
        .when(query == "SUM", F.col("true_sum"))
        .when(query == "MEAN", F.col("true_mean"))
        .otherwise(F.col("true_variance"))
    )
    answers = _answers(low, high, grid, noise)
    chosen: Column | None = None
    for (q, m), answer in answers.items():
        if (q, m) not in trials:
            continue
        here = (query == q) & (mechanism == m)
        chosen = F.when(here, answer) if chosen is None else chosen.when(here, answer)
    answered = rows.select(
        *TRIAL_KEY, "iteration", "n", truth.alias("truth"), chosen.alias("answer")
    )
    return answered.withColumns(error_columns("truth", "answer", F.col("n").cast("double")))


def _answers(low: float, high: float, grid: float, noise: SeededNoise) -> dict[tuple[str, str], Column]:
    n, epsilon = F.col("n").cast("double"), F.col("epsilon")
    half, most = (high - low) / 2.0, max(abs(low), abs(high))
    key = [*TRIAL_KEY, "iteration"]

    def laplace(label: str, sensitivity: Column | float, share: int = 1) -> Column:
        s = sensitivity if isinstance(sensitivity, Column) else F.lit(float(sensitivity))
        return noise.noise("laplace", label, s / (epsilon / F.lit(float(share))), key)

    def geometric(label: str, sensitivity: float, share: int = 1) -> Column:
        return noise.noise("geometric", label, F.lit(float(sensitivity)) / (epsilon / F.lit(float(share))), key)

    mean = F.col("m1") / n
    spread = (F.col("m2") - F.col("m1") * mean) / F.greatest(n - 1.0, F.lit(1.0))

    def from_noisy_size(share: int) -> tuple[Column, Column]:
        size = F.greatest(n + geometric("n", 1.0, share), F.lit(1.0))
        return size, (F.col("m1") + laplace("m1", half, share)) / size

    mean_size, mean_shift = from_noisy_size(2)
    var_size, var_shift = from_noisy_size(3)
    noisy_spread = (F.col("m2") + laplace("m2", half * half, 3)) / var_size - var_shift * var_shift
    noisy_spread = F.greatest(F.least(noisy_spread, F.lit(half * half)), F.lit(0.0))
    steps = math.ceil(most / grid)
    return {
        ("COUNT", "geometric"): n + geometric("n", 1.0),
        ("COUNT", "laplace"): n + laplace("n", 1.0),
        ("SUM", "geometric"): (F.col("grid_sum") + geometric("sum", steps)) * F.lit(grid),
        ("SUM", "laplace"): F.col("bounded_sum") + laplace("sum", most),
        ("MEAN", "public_size"): mean + F.lit((low + high) / 2.0) + laplace("mean", F.lit(high - low) / n),
        ("MEAN", "noisy_size"): F.greatest(
            F.least(F.lit((low + high) / 2.0) + mean_shift, F.lit(float(high))), F.lit(float(low))
        ),
        ("VARIANCE", "public_size"): spread + laplace("variance", F.lit((high - low) ** 2) / n),
        ("VARIANCE", "noisy_size"): noisy_spread * var_size / F.greatest(var_size - 1.0, F.lit(1.0)),
    }


def summarise_trials(trials: DataFrame, keys: Sequence[str] = TRIAL_KEY, digits: int | None = None) -> DataFrame:
    """Mean and population deviation of the three errors; rounded half-even only if asked to."""
    columns = []
    for name in ("error", "relative_error", "scaled_error"):
        for prefix, value in (("mean", F.avg(name)), ("stdev", F.stddev_pop(name))):
            value = value if digits is None else F.bround(value, digits)
            columns.append(value.alias(f"{prefix}_{name}"))
    return trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), *columns)


def compare_mechanisms(summary: DataFrame, mechanisms: Sequence[str] = MECHANISMS) -> DataFrame:
    """Mean error of each mechanism side by side per statistic and epsilon, and the best one."""
    per = summary.groupBy("query", "epsilon", "mechanism").agg(F.avg("mean_error").alias("mean_error"))
    wide = per.groupBy("query", "epsilon").agg(
        *[F.max(F.when(F.col("mechanism") == m, F.col("mean_error"))).alias(m) for m in mechanisms],
        F.min_by("mechanism", "mean_error").alias("best"),
    )
    return wide


def error_by_feature(summary: DataFrame, features: Sequence[str]) -> DataFrame:
    """Errors by dataset size, scale or skew; ``summary`` carries them (see ``dataset_features``)."""
    return summary.groupBy(*features, "query", "mechanism").agg(
        F.avg("mean_error").alias("mean_error"),
        F.avg("mean_relative_error").alias("mean_relative_error"),
        F.avg("mean_scaled_error").alias("mean_scaled_error"),
        F.count(F.lit(1)).alias("settings"),
    )
