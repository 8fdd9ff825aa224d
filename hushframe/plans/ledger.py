"""Privacy accounting over a table of spends.

A spend is a row (session, partition, query, mechanism, epsilon, delta, rho, ts). Everything is grouped
by session, so an audit of many sessions is one aggregation. Losses are added as decimals, each rounded up to the
twelfth place and limits down: whether a limit is exceeded must not depend on the order in which tasks finish, and many
small spends must not vanish.

An audit is in one measure. In ``epsilon`` every spend needs an epsilon, and deltas are added beside; in
``zcdp`` a spend counts its rho, or half the square of its epsilon if it has no delta. A spend that the measure
cannot express is refused, never left out: convert the ledger first (``convert_spends``).
"""

from __future__ import annotations

import math
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.calibration import pure_to_zcdp, zcdp_to_epsilon
from hushframe.operators.matching import null_safe_join, null_safe_semi_join
from hushframe.plans.materialise import materialise

SPENDS = (
    "session string, partition string, query string, mechanism string, "
    "epsilon double, delta double, rho double, ts timestamp"
)
MEASURES = ("epsilon", "zcdp")


#: The last place of a loss.
PLACE = Decimal("0.000000000001")


def _units(c: str) -> Column:
    """A loss with twelve decimals, whose sums are exact."""
    return _units_of(F.col(c))


def _limit(limit: float) -> Column:
    return F.lit(Decimal(repr(float(limit))).quantize(PLACE, ROUND_FLOOR)).cast("decimal(28,12)")


def _plain(units: Column) -> Column:
    """A total of losses, narrow enough that a sum or difference of two keeps all twelve places."""
    return units.cast("decimal(37,12)")


def _amount(units: Column) -> Column:
    return units.cast("double")


def _refuse(why: str) -> Column:
    return F.raise_error(F.lit(why)).cast("double")


def _epsilon() -> Column:
    return F.coalesce(F.col("epsilon"), _refuse("a spend without an epsilon: convert the ledger or audit it in zcdp"))


def loss(measure: str) -> Column:
    """What a spend costs in the measure of the audit."""
    if measure == "epsilon":
        return _epsilon()
    if measure == "zcdp":
        pure = F.when(F.coalesce("delta", F.lit(0.0)) == 0, pure_to_zcdp("epsilon"))
        return F.coalesce(F.col("rho"), pure, _refuse("a spend that has no rho"))
    raise ValueError(f"unknown measure: {measure}, choose from {MEASURES}")


def _beyond(spent: Column, limit: float) -> Column:
    return F.lit(False) if math.isinf(limit) else spent > _limit(limit)


def totals(spends: DataFrame, limit: float, measure: str = "epsilon") -> DataFrame:
    """Spent epsilon, delta and rho, number of spends, and what remains of the limit, per session.

    The limit, which may be infinite, is an epsilon or a rho, as the measure says. In zcdp the rho of pure
    spends is part of the total rho.
    """
    spent = F.sum(_units_of(loss(measure)))
    left = F.lit(math.inf) if math.isinf(limit) else _amount(_limit(limit) - _plain(spent))
    rho = spent if measure == "zcdp" else F.coalesce(F.sum(_units("rho")), F.lit(0))
    epsilon = spent if measure == "epsilon" else F.coalesce(F.sum(_units("epsilon")), F.lit(0))
    return spends.groupBy("session").agg(
        _amount(epsilon).alias("epsilon"),
        F.sum("delta").alias("delta"),
        _amount(rho).alias("rho"),
        F.count(F.lit(1)).alias("spends"),
        left.alias("remaining"),
        _beyond(spent, limit).alias("over_limit"),
    )


def _units_of(value: Column) -> Column:
    """The least decimal with twelve places that is no smaller than the double."""
    value = value.cast("double")
    near = value.cast("decimal(28,12)")
    short = near.cast("double") < value
    return F.when(short, (near + F.lit(PLACE)).cast("decimal(28,12)")).otherwise(near)


def first_overrun(spends: DataFrame, limit: float, measure: str = "epsilon") -> DataFrame:
    """Per session the moment at which its running total first exceeds the limit.

    Running totals are taken per day, then per second of the day found, then per instant of the second
    found. Spends are added up before each window, so that a window orders calendar units and never the
    raw spends of a busy session. Sessions within the limit have no row, and with an infinite limit none has.
    The ledger is read twice: for the days, and for what lies on the days found, which is written.
    """
    scope = spends.select("session", "ts", _units_of(loss(measure)).alias("_spent"), F.lit(0).alias("_before"))
    for bucket in _calendar(spends):
        found = _first_crossing(scope, bucket, limit)
        opening = found.select(
            "session",
            F.col("_at").alias("_open"),
            (_plain(F.col("_upto")) - _plain(F.col("_spent"))).alias("_before"),
        )
        inside = scope.drop("_before").withColumn("_open", bucket)
        inside = null_safe_join(inside, opening, ["session", "_open"])
        scope = inside.groupBy("session", "_before", "ts").agg(F.sum("_spent").alias("_spent"))
        scope = materialise(scope, "overrun")
    found = _first_crossing(scope, F.col("ts"), limit)
    name = "epsilon" if measure == "epsilon" else "rho"
    return found.select("session", F.col("_at").alias("ts"), _amount(F.col("_upto")).alias(name))


def _calendar(spends: DataFrame) -> tuple[Column, Column]:
    """Day and second numbers of ``ts`` as elapsed time, which clock changes do not shift."""
    elapsed = F.col("ts") - F.lit("1970-01-01 00:00:00").cast(spends.schema["ts"].dataType)
    day, hour, minute, second = [F.extract(F.lit(f), elapsed) for f in ("DAY", "HOUR", "MINUTE", "SECOND")]
    of_day = hour * F.lit(3600) + minute * F.lit(60) + F.floor(second)
    return day.cast("bigint"), day.cast("bigint") * F.lit(86400) + of_day.cast("bigint")


def _first_crossing(scope: DataFrame, at: Column, limit: float) -> DataFrame:
    """Per session the first bucket ``_at`` in which the total reaches beyond the limit."""
    buckets = scope.groupBy("session", "_before", at.alias("_at")).agg(F.sum("_spent").alias("_spent"))
    upto = F.sum("_spent").over(Window.partitionBy("session").orderBy("_at"))
    over = buckets.withColumn("_upto", _plain(F.col("_before")) + _plain(upto)).filter(_beyond(F.col("_upto"), limit))
    first = Window.partitionBy("session").orderBy("_at")
    return over.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")


def compose_advanced(spends: DataFrame, slack: float) -> DataFrame:
    """Total epsilon and delta per session when ``slack`` of delta is given up.

    The smallest of the linear total and the two bounds of Kairouz, Oh and Viswanath (2015).
    """
    return advanced_totals(spends, slack, _epsilon()).drop("_given")


def advanced_totals(spends: DataFrame, slack: float, e: Column) -> DataFrame:
    """The same of the spends whose epsilon ``e`` is not NULL; ``_given`` is their number."""
    sums = spends.groupBy("session").agg(
        F.sum(e).alias("_linear"),
        F.sum(e * e).alias("_squares"),
        F.sum(e * (F.exp(e) - 1) / (F.exp(e) + 1)).alias("_drift"),
        F.sum(F.log1p(-F.coalesce("delta", F.lit(0.0)))).alias("_log_safe"),
        F.count(F.lit(1)).alias("spends"),
        F.count(e).alias("_given"),
    )
    if not 0 <= slack < 1:
        raise ValueError(f"slack must lie in [0, 1), got {slack}")
    total = F.col("_linear")
    if slack > 0:
        square = F.lit(2.0) * F.col("_squares")
        first = F.col("_drift") + F.sqrt(square * F.lit(math.log(1.0 / slack)))
        inner = F.lit(math.e) + F.sqrt(F.col("_squares")) / F.lit(slack)
        second = F.col("_drift") + F.sqrt(square * F.log(inner))
        total = F.least(total, first, second)
    delta = F.lit(1.0) - F.lit(1.0 - slack) * F.exp(F.col("_log_safe"))
    return sums.select("session", total.alias("epsilon"), delta.alias("delta"), "spends", "_given")


def parallel_compose(spends: DataFrame, measure: str = "epsilon") -> DataFrame:
    """Spends on disjoint partitions count once: the largest partition total per session, as epsilon or rho."""
    per_partition = spends.groupBy("session", "partition").agg(F.sum(_units_of(loss(measure))).alias("_spent"))
    return per_partition.groupBy("session").agg(
        _amount(F.max("_spent")).alias("epsilon" if measure == "epsilon" else "rho"),
        F.count(F.lit(1)).alias("partitions"),
    )


def convert_spends(spends: DataFrame, delta: float) -> DataFrame:
    """Each spend in all three notions: a rho of its own is kept, otherwise it follows from a pure epsilon.

    ``approx_delta`` is the spend's own delta, and ``delta`` more if its epsilon was bought from a rho. A spend with
    a delta of its own satisfies no zCDP: its ``zcdp_rho`` is NULL.
    """
    own = F.coalesce("delta", F.lit(0.0)) if "delta" in spends.columns else F.lit(0.0)
    bought = F.col("rho").isNotNull()
    rho = F.when(own == 0, F.coalesce(F.col("rho"), pure_to_zcdp("epsilon")))
    approx = F.when(bought, zcdp_to_epsilon("rho", delta)).otherwise(F.col("epsilon"))
    spare = own + F.when(bought, F.lit(float(delta))).otherwise(F.lit(0.0))
    return spends.withColumns(
        {"zcdp_rho": rho, "approx_epsilon": approx, "approx_delta": spare}
    )


def split_budget(plan: DataFrame, total: float, weight: str = "weight") -> DataFrame:
    """Share a total epsilon over the queries of each session in proportion to their weights, of any size.

    The weights are summed by aggregation and joined back, not by a window over the session's rows.
    """
    sums = plan.groupBy("session").agg(F.sum(F.col(weight).cast("double")).alias("_weights"))
    share = F.lit(float(total)) * F.col(weight) / F.col("_weights")
    return null_safe_join(plan, sums, ["session"]).withColumn("epsilon", share).drop("_weights")


def split_total(total: float, weights: dict[str, float]) -> dict[str, float]:
    """The same for the handful of queries of one planned session."""
    whole = math.fsum(weights.values())
    return {name: total * w / whole for name, w in weights.items()}
