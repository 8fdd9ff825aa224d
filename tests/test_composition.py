"""Tight composition against exact sums and integrals, and the optimal selection of keys against its recurrence."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.functions.calibration import advanced_epsilon, release_chance, selection_threshold
from hushframe.functions.noise import SecureNoise, SeededNoise
from hushframe.operators import private as P
from hushframe.operators.bounding import PrivacyUnit
from hushframe.plans import ledger as L
from hushframe.plans import composition as tight
from hushframe.plans.composition import compose_tight, tight_epsilon

LEDGER = "session string, mechanism string, epsilon double, delta double, rho double"


def normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def gaussian_delta(mu: float, epsilon: float) -> float:
    return normal(mu / 2 - epsilon / mu) - math.exp(epsilon) * normal(-mu / 2 - epsilon / mu)


def laplace_parts(epsilon: float, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Losses and masses of Laplace noise, the middle cut into narrow cells."""
    edges = np.linspace(0.0, 1.0, cells + 1)
    mass = -0.5 * np.diff(np.exp(-epsilon * edges))
    middle = (edges[1:] + edges[:-1]) / 2
    losses = np.concatenate([[epsilon, -epsilon], epsilon - 2 * epsilon * middle])
    return losses, np.concatenate([[0.5, 0.5 * math.exp(-epsilon)], mass])


@pytest.mark.parametrize("sizes", [[1.0], [0.5, 0.25], [0.4, 0.3, 0.7], [0.1] * 12])
@pytest.mark.parametrize("slack", [1e-2, 1e-6])
def test_pure_spends_against_all_outcomes(sizes, slack):
    """Every combination of answers of randomised response, up to signs."""
    found = tight_epsilon([("pure", s, sizes.count(s)) for s in set(sizes)], slack)

    def delta(epsilon: float) -> float:
        total = 0.0
        for signs in product((1, -1), repeat=len(sizes)):
            loss = sum(a * s for a, s in zip(signs, sizes))
            if loss > epsilon:
                p = math.prod(1 / (1 + math.exp(-a * s)) for a, s in zip(signs, sizes))
                total += p * -math.expm1(epsilon - loss)
        return total

    assert delta(found) <= slack
    assert found == 0 or delta(found * 0.999 - 1e-4) > slack
    assert found <= advanced_epsilon(sizes, slack) * 1.001 + 1e-4


@pytest.mark.parametrize("mus", [[1.0], [0.5, 0.25], [0.5, 0.75, 1.5], [0.01] * 2000, [0.05] * 40 + [0.5]])
def test_gaussian_spends_against_the_closed_form(mus):
    found = tight_epsilon([("gaussian", m, mus.count(m)) for m in set(mus)], 1e-6)
    whole = math.sqrt(math.fsum(m * m for m in mus))
    assert gaussian_delta(whole, found) <= 1e-6
    assert gaussian_delta(whole, found * 0.9999) > 1e-6


def test_mixed_spends_against_integrals():
    """One Gaussian spend with one and with two Laplace spends."""
    losses, mass = laplace_parts(0.5, 2000)
    for slack in (1e-3, 1e-6):
        found = tight_epsilon([("gaussian", 1.0, 1), ("laplace", 0.5, 1)], slack)

        def one(epsilon: float) -> float:
            return math.fsum(m * gaussian_delta(1.0, epsilon - x) for x, m in zip(losses, mass))

        assert one(found * 0.9995) > slack >= one(found) * 0.9999
    short, weight = laplace_parts(0.25, 150)
    few, few_mass = laplace_parts(0.5, 150)
    found = tight_epsilon([("gaussian", 1.0, 1), ("laplace", 0.5, 1), ("laplace", 0.25, 1)], 1e-4)

    def two(epsilon: float) -> float:
        pairs = product(zip(few, few_mass), zip(short, weight))
        return math.fsum(a * b * gaussian_delta(1.0, epsilon - x - y) for (x, a), (y, b) in pairs)

    assert two(found * 0.999) > 1e-4 >= two(found) * 0.999


def test_a_session_of_many_sizes_costs_one_transform(monkeypatch):
    """A Gaussian spend leaves few frequencies, at which all other spends are known in closed form."""
    calls = []
    for name in ("rfft", "irfft"):
        whole = getattr(np.fft, name)
        monkeypatch.setattr(np.fft, name, lambda *given, whole=whole: calls.append(1) or whole(*given))
    spends = [("laplace", 0.01 + 0.001 * i, 1) for i in range(60)] + [("pure", 0.02, 3), ("gaussian", 0.2, 2), ("gaussian", 0.1, 1)]
    found = tight_epsilon(spends, 1e-5)
    assert len(calls) == 1
    monkeypatch.undo()
    step = 0.002
    total = tight.gaussian_losses(0.3, step)
    mass, low = total.mass, total.low
    for kind, size, count in spends[:61]:
        one = tight.Spends([kind], [size], step).losses(0)
        for _ in range(count):
            mass, low = np.convolve(mass, one.mass), low + one.low
    assert found == pytest.approx(tight.Losses(low, mass, total.lost).epsilon(1e-5, step), rel=1e-4)


def test_a_session_without_gaussian_spends_costs_no_transform(monkeypatch):
    """Spends of many sizes are added up on the grid; the result is that of plain convolutions."""
    for name in ("rfft", "irfft"):
        monkeypatch.setattr(np.fft, name, lambda *given: pytest.fail("a transform"))
    spends = [("laplace" if i % 4 else "pure", 0.005 + 0.004 * i, 1 + (i % 9 == 0)) for i in range(30)]
    spends += [("laplace", 1e-7, 2), ("pure", 1e-7, 1), ("laplace", 0.25, 1)]
    step = math.sqrt(math.fsum(n * x * x for _, x, n in spends)) / tight.FINE
    mass, low = np.ones(1), 0
    for kind, size, count in spends:
        one = tight.Spends([kind], [size], step).losses(0)
        for _ in range(count):
            mass, low = np.convolve(mass, one.mass), low + one.low
    for slack in (0.3, 1e-3, 1e-7):
        assert tight_epsilon(spends, slack) == pytest.approx(tight.Losses(low, mass, 0.0).epsilon(slack, step), rel=1e-5 * 1e-7 / slack + 1e-9)
    assert tight_epsilon(spends, 0.99) == 0.0


@pytest.mark.parametrize(("kind", "size", "count"), [("pure", 1.0, 40), ("pure", 0.05, 400), ("laplace", 6.0, 20), ("pure", 0.2, 150)])
def test_spends_of_one_size_in_both_ways(kind, size, count):
    """Added up one by one and by transforms; both err upwards."""
    step = math.sqrt(count * size * size) / tight.FINE
    one_by_one = tight_epsilon([(kind, size, count)], 1e-5)
    assert one_by_one == pytest.approx(tight.composed(0.0, [(kind, size, count)], step, 1e-14).epsilon(1e-5, step), rel=1e-6)
    if kind == "pure":
        chances = [math.lgamma(count + 1) - math.lgamma(k + 1) - math.lgamma(count - k + 1) for k in range(count + 1)]
        parts = [((2 * k - count) * size, c - k * math.log1p(math.exp(-size)) - (count - k) * math.log1p(math.exp(size))) for k, c in enumerate(chances)]
        delta = math.fsum(math.exp(c) * -math.expm1(one_by_one - loss) for loss, c in parts if loss > one_by_one)
        assert 0.99e-5 < delta <= 1e-5


@pytest.mark.parametrize(("size", "count"), [(23.0, 30), (23.5, 29), (24.0, 29), (12.0, 58), (1.4, 499)])
def test_totals_near_the_largest_loss(size, count):
    """No overflow; where all losses but the largest are rare, epsilon is the total, up to the grid."""
    found = tight_epsilon([("pure", size, count)], 1e-6)
    assert size * count * 0.5 < found <= size * count * (1 + 1e-3)
    assert found == pytest.approx(size * count, rel=1e-3) or size < 12


@pytest.mark.parametrize("slack", [1e-12, 3e-13, 1e-13])
def test_slack_near_the_rounding(slack):
    spends = [("laplace", 0.01 * (i + 1), 1) for i in range(12)]
    assert tight_epsilon(spends, 1e-9) < tight_epsilon(spends, slack)


def test_sessions_that_go_on_in_the_next_batch(spark):
    rows = [(s, "laplace", 0.01 * (1 + i), 0.0, None) for s in (7, None, 3, 9) for i in range(s or 2)]
    ledger = spark.createDataFrame(rows, LEDGER.replace("string", "int", 1))
    whole = {r["session"]: r["epsilon"] for r in tight.compose_losses(ledger, 1e-5).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        cut = tight.compose_losses(ledger, 1e-5)
        assert cut.schema["session"].dataType == ledger.schema["session"].dataType
        assert {r["session"]: r["epsilon"] for r in cut.collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert set(whole) == {7, None, 3, 9} and whole[9] > whole[7] > whole[3] > whole[None] > 0


def test_more_spends_cost_more():
    totals = [tight_epsilon([("laplace", 0.01, n)], 1e-5) for n in (1, 10, 100, 10_000, 1_000_000)]
    assert totals == sorted(totals) and totals[0] <= 0.0101
    assert tight_epsilon([("laplace", 0.3, 5)], 1e-5) <= tight_epsilon([("pure", 0.3, 5)], 1e-5)


def test_extremes():
    assert tight_epsilon([], 1e-5) == 0.0
    assert tight_epsilon([("pure", 0.0, 3)], 1e-5) == 0.0
    assert tight_epsilon([("pure", math.inf, 1)], 1e-5) == math.inf
    assert tight_epsilon([("pure", 20.0, 10**6)], 1e-5) == math.inf
    assert tight_epsilon([("gaussian", 1e-9, 1)], 1e-3) == 0.0


def test_ledger_of_sessions(spark):
    """Never above the closed forms; deltas add as there; a Gaussian spend needs its rho only; NULL is a session."""
    rows = [("a", "laplace", 0.1, 0.0, None)] * 200 + [("b", "count", 0.3, 1e-7, None)] * 30
    rows += [("c", "gaussian", None, None, 0.02)] * 25 + [(None, "laplace", 0.5, 0.0, None), ("z", "laplace", 0.0, 0.0, None)]
    ledger = spark.createDataFrame(rows, LEDGER)
    tight = {r["session"]: r for r in compose_tight(ledger, 1e-5).collect()}
    closed = {r["session"]: r for r in L.compose_advanced(ledger.filter("epsilon is not null"), 1e-5).collect()}
    assert set(tight) == {"a", "b", "c", "z", None}
    for session, r in closed.items():
        assert tight[session]["epsilon"] <= r["epsilon"]
        assert tight[session]["delta"] == r["delta"] and tight[session]["spends"] == r["spends"]
    assert tight["a"]["epsilon"] < 0.85 * closed["a"]["epsilon"]
    assert tight[None]["epsilon"] <= 0.5 and tight["z"]["epsilon"] == 0.0
    assert gaussian_delta(1.0, tight["c"]["epsilon"]) <= 1e-5
    assert gaussian_delta(1.0, tight["c"]["epsilon"] * 0.995) > 1e-5
    assert compose_tight(ledger.limit(0), 1e-5).count() == 0


def test_spends_that_cannot_be_composed(spark):
    bare = spark.createDataFrame([("a", "gaussian", None, 0.0, None)], LEDGER)
    with pytest.raises(Exception, match="neither an epsilon nor a Gaussian rho"):
        compose_tight(bare, 1e-5).collect()
    with pytest.raises(ValueError):
        compose_tight(bare, 0.0)


def test_a_busy_session_reaches_a_task_as_few_rows(spark):
    """A million spends of different sizes are a few thousand classes."""
    spends = spark.range(1_000_000).select(
        F.lit("s").alias("session"), F.lit("laplace").alias("mechanism"),
        (F.lit(1e-4) + F.col("id") * 1e-9).alias("epsilon"), F.lit(0.0).alias("delta"), F.lit(None).cast("double").alias("rho"),
    )
    r = compose_tight(spends, 1e-6).first()
    assert r["spends"] == 1_000_000
    assert 1.0 < r["epsilon"] < L.compose_advanced(spends, 1e-6).first()["epsilon"]


@pytest.mark.parametrize(("epsilon", "delta", "partitions"), [(1.0, 1e-5, 1), (0.1, 1e-3, 1), (3.0, 1e-2, 2), (0.5, 0.3, 1), (5.0, 1e-6, 4)])
def test_release_chance_is_the_recurrence(spark, epsilon, delta, partitions):
    n = 400
    found = [r[0] for r in spark.range(n).select(release_chance("id", epsilon, delta, partitions)).collect()]
    e, d = epsilon / partitions, 1 - (1 - delta) ** (1 / partitions)
    wanted = [0.0]
    for _ in range(n - 1):
        p = wanted[-1]
        wanted.append(min(math.exp(e) * p + d, 1 - math.exp(-e) * (1 - p - d), 1.0))
    assert found == pytest.approx(wanted, rel=1e-9, abs=1e-15)
    for p, q in zip(found, found[1:]):
        assert q <= math.exp(e) * p + d + 1e-12
        assert 1 - p <= math.exp(e) * (1 - q) + d + 1e-12
    threshold = selection_threshold(epsilon, delta, partitions)

    def laplace_keeps(count: int) -> float:
        gap = (count - threshold) * e
        return 0.5 * math.exp(gap) if gap < 0 else 1 - 0.5 * math.exp(-gap)

    assert all(p >= laplace_keeps(i) - 1e-12 for i, p in enumerate(found) if i)


@pytest.mark.parametrize("noise", [SeededNoise(5), SecureNoise()])
def test_optimal_selection_of_keys(spark, noise):
    rows = spark.range(2000).select(
        F.col("id").alias("unit"), F.when(F.col("id") < 1500, "common").when(F.col("id") < 1990, None)
        .otherwise(F.col("id").cast("string")).alias("kind"),
    )
    kept = P.select_partitions_optimal(rows, PrivacyUnit("unit"), ["kind"], 1.0, 1e-6, noise)
    assert kept.columns == ["kind"]
    assert {r["kind"] for r in kept.collect()} == {"common", None}
    with pytest.raises(ValueError):
        P.select_partitions_optimal(rows, PrivacyUnit(), ["kind"], 1.0, 1e-6, noise)
