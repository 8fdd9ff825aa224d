"""Differentially private analytics on Spark DataFrames."""

from hushframe.functions.noise import Draw, SecureNoise, SeededNoise
from hushframe.operators.bounding import ROW, PrivacyUnit
from hushframe.operators.private import (
    dp_aggregate,
    dp_count,
    dp_count_nonzero,
    dp_filtered_count,
    dp_group_count,
    dp_mean,
    dp_privacy_id_count,
    dp_std,
    dp_sum,
    dp_variance,
    select_partitions,
)
from hushframe.plans.adaptive import two_phase_count
from hushframe.plans.evaluation import run_trials, summarise_trials
from hushframe.plans.session import BudgetExceeded, PrivacySession, Query, UnsafeStep

__all__ = [
    "ROW",
    "BudgetExceeded",
    "Draw",
    "PrivacySession",
    "PrivacyUnit",
    "Query",
    "SecureNoise",
    "SeededNoise",
    "UnsafeStep",
    "dp_aggregate",
    "dp_count",
    "dp_count_nonzero",
    "dp_filtered_count",
    "dp_group_count",
    "dp_mean",
    "dp_privacy_id_count",
    "dp_std",
    "dp_sum",
    "dp_variance",
    "run_trials",
    "select_partitions",
    "summarise_trials",
    "two_phase_count",
]
