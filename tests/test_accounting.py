"""Calibration, ledger and sessions."""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hushframe.functions import calibration as C
from hushframe.functions.noise import SecureNoise, SeededNoise
from hushframe.operators.bounding import PrivacyUnit
from hushframe.operators.histograms import Axis
from hushframe.plans import ledger as L
from hushframe.plans.session import BudgetExceeded, PrivacySession, Query, UnsafeStep

QUIET = SeededNoise(3)


@pytest.mark.parametrize(
    ("d_in", "d_out", "measure", "scale"),
    [(1, 1, "pure", 1), (2, 1, "pure", 2), (1, 2, "pure", 0.5), (1, 1, "zcdp", 0.5), (2, 1, "zcdp", 2),
     (1, 2, "zcdp", 0.25), (4, 8, "zcdp", 1)],
)
def test_noise_scale(spark, d_in, d_out, measure, scale):
    df = spark.createDataFrame([(d_in, d_out, measure)], "d_in int, d_out int, measure string")
    assert df.select(C.noise_scale("d_in", "d_out", F.col("measure"))).first()[0] == scale
    assert C.scale_for(d_in, d_out, measure) == scale


@pytest.mark.parametrize("budget", [0, -1, None])
def test_no_budget_is_rejected(spark, budget):
    df = spark.createDataFrame([(1, budget)], "d_in int, d_out int")
    with pytest.raises(Exception, match="privacy budget must be positive"):
        df.select(C.noise_scale("d_in", "d_out", F.lit("pure"))).collect()


def test_loss_of_groups(spark):
    rows = [("geometric", 2.0, 1, 0.5), ("geometric", 2.0, 4, 2.0), ("laplace", 2.0, 1, 0.5), ("discrete_gaussian", 16.0, 2, 0.125)]
    df = spark.createDataFrame(rows, "mechanism string, scale double, d_in int, expected double")
    lost = df.withColumn("loss", C.privacy_loss("mechanism", "scale", "d_in")).withColumn("ok", C.satisfied("loss", 0.5))
    for r in lost.collect():
        assert r["loss"] == r["expected"] and r["ok"] == (r["expected"] <= 0.5)


def test_conversion(spark):
    df = spark.createDataFrame([(1.0, None), (9.0, 0.5)], "epsilon double, rho double")
    rows = L.convert_spends(df, 1e-6).collect()
    assert (rows[0]["zcdp_rho"], rows[0]["approx_epsilon"], rows[0]["approx_delta"]) == (0.5, 1.0, 0.0)
    assert rows[1]["approx_epsilon"] == pytest.approx(0.5 + 2 * math.sqrt(0.5 * math.log(1e6)))


def spends(spark, rows):
    """(session, partition, epsilon, delta, minute) as a table of spends."""
    start = datetime(2024, 1, 1, 23, 50)
    full = [(s, p, "q", "laplace", e, d, None, start + timedelta(minutes=m)) for s, p, e, d, m in rows]
    return spark.createDataFrame(full, L.SPENDS)


def test_composition_with_slack(spark):
    thirty = spends(spark, [("s", "all", 2.0**-6, 0.0, i) for i in range(30)])
    assert L.compose_advanced(thirty, 0.0).first()["epsilon"] == 0.46875
    answer = L.compose_advanced(thirty, 1e-3).first()
    assert answer["epsilon"] == pytest.approx(0.259857, abs=1e-6)
    assert answer["delta"] == pytest.approx(1e-3)
    assert answer["spends"] == 30


def test_totals_are_exact(spark):
    row = L.totals(spends(spark, [("s", "all", 0.1, 1e-7, i) for i in range(10)]), 1.0).first()
    assert (row["epsilon"], row["remaining"], row["over_limit"], row["spends"]) == (1.0, 0.0, False, 10)
    four = L.totals(spends(spark, [("s", "all", 0.04, 0.0, i) for i in range(4)]), 1.0).first()
    assert (four["epsilon"], four["remaining"]) == (0.16, 0.84)


def test_first_overrun(spark):
    rows = [("busy", "all", 0.25, 0.0, i // 3) for i in range(60)] + [("calm", "all", 0.1, 0.0, i) for i in range(5)]
    found = L.first_overrun(spends(spark, rows), 2.0).collect()
    assert len(found) == 1
    assert found[0]["session"] == "busy"
    assert found[0]["ts"] == datetime(2024, 1, 1, 23, 52) and found[0]["epsilon"] == 2.25


def test_overrun_on_a_later_day(spark):
    found = L.first_overrun(spends(spark, [("s", "all", 0.25, 0.0, i) for i in range(30)]), 4.0).first()
    assert found["ts"] == datetime(2024, 1, 2, 0, 6) and found["epsilon"] == 4.25


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_overrun_across_a_clock_change(spark, kind):
    """Local times between 2 and 3 o'clock of that night do not exist in this zone."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [("s", f"2024-03-10 0{h}:{m:02d}:00") for h in (1, 2, 3) for m in range(0, 60, 10)]
        df = spark.createDataFrame(rows, "session string, at string")
        at = F.col("at").cast(kind) if kind == "timestamp_ntz" else F.to_timestamp(F.concat("at", F.lit("+00:00")))
        df = df.select("session", at.alias("ts"), F.lit(1.0).alias("epsilon"))
        for limit in range(len(rows)):
            found = L.first_overrun(df, float(limit)).select(F.col("epsilon"), F.col("ts")).first()
            expected = df.orderBy("ts").collect()[limit]["ts"]
            assert (found["epsilon"], found["ts"]) == (limit + 1.0, expected)
            if limit == 8:
                break
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parallel(spark):
    rows = [("s", "a", 0.5, 0.0, 0), ("s", "a", 0.5, 0.0, 1), ("s", "b", 0.7, 0.0, 2)]
    answer = L.parallel_compose(spends(spark, rows)).first()
    assert (answer["epsilon"], answer["partitions"]) == (1.0, 2)


def test_split(spark):
    plan = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 9.0), ("t", "a", 2.0)], "session string, query string, weight double")
    shares = {(r["session"], r["query"]): r["epsilon"] for r in L.split_budget(plan, 100.0).collect()}
    assert shares == pytest.approx({("s", "a"): 10.0, ("s", "b"): 90.0, ("t", "a"): 100.0})
    assert L.split_total(1.0, {"coarse": 1, "fine": 9}) == pytest.approx({"coarse": 0.1, "fine": 0.9})


@pytest.fixture()
def people(spark):
    rows = [(i, 19 + i % 60, "Mumps" if i % 10 == 0 else "Rubella") for i in range(100)]
    return spark.createDataFrame(rows, "id int, age int, disease string")


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_session(people):
    session = PrivacySession.from_dataframe(people, "people", 3.0, noise=QUIET)
    total = session.evaluate(Query("people").count(), 1.0)
    assert total.columns == ["count"]
    sick = session.evaluate(Query("people").filter("disease IN ('Mumps', 'Typhoid')").count(), 1.0)
    assert abs(sick.first()[0] - 10) < 30
    assert session.remaining == 1.0 and len(session) == 2
    mean = session.evaluate(Query("people").average("age", 0, 120), 1.0)
    assert 0 <= mean.first()["mean"] <= 120
    assert session.remaining == 0.0
    rows = session.spends().collect()
    assert [r["epsilon"] for r in rows] == [1.0, 1.0, 1.0]


def test_overrun_is_refused_before_any_job(spark, people):
    session = PrivacySession.from_dataframe(people, "people", 1.5, noise=QUIET)
    session.evaluate(Query("people").count(), 1.0)
    before = jobs(spark)
    with pytest.raises(BudgetExceeded):
        session.evaluate(Query("people").variance("age", 0, 120), 1.0)
    assert jobs(spark) == before
    assert session.remaining == 0.5


def test_infinite_budget(people):
    session = PrivacySession.from_dataframe(people, "people", math.inf, noise=QUIET)
    session.evaluate(Query("people").sum("age", 0, 120), 1e6)
    assert session.remaining == math.inf


def test_ten_tenths_fit(people):
    session = PrivacySession.from_dataframe(people, "people", 1.0, noise=QUIET)
    for _ in range(10):
        session._charge(0.1, "count", "count")
    with pytest.raises(BudgetExceeded):
        session._charge(1e-6, "count", "count")


def test_join_raises_the_noise_of_a_view(spark, people):
    """Each person becomes two rows, so the noise of a count is twice as wide."""
    public = spark.createDataFrame([("Mumps", 1), ("Mumps", 2), ("Rubella", 1)], "disease string, ward int")
    session = PrivacySession.from_dataframe(people, "people", 10.0, noise=QUIET)
    query = Query("people").join_public(public, ["disease"])
    assert query.influence == 2
    session.create_view(query, "wards")
    assert session._influence["wards"] == 2
    with pytest.raises(ValueError):
        session.create_view(query, "wards")


def test_partition_costs_once(people):
    session = PrivacySession.from_dataframe(people, "people", 2.0, noise=QUIET)
    parts = session.partition_and_spend("people", "disease", {"m": "Mumps", "r": "Rubella"}, 1.5)
    assert session.remaining == 0.5
    for part in parts.values():
        part.evaluate(Query("people").count(), 1.5)
        with pytest.raises(BudgetExceeded):
            part.evaluate(Query("people").count(), 0.1)
    with pytest.raises(BudgetExceeded):
        session.partition_and_spend("people", "disease", {"m": "Mumps"}, 1.0)


def test_partition_bounds_units_that_are_in_several_parts(spark):
    rows = [(i % 10, "ab"[i % 2], i) for i in range(100)] + [(i % 10, "ab"[(i + 1) % 2], 100 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "unit int, part string, id int")
    unit = PrivacyUnit("unit", partitions=1, rows=50, row_key=("id",))
    session = PrivacySession.from_dataframe(df, "t", 1.0, unit=unit, noise=QUIET)
    children = session.partition_and_spend("t", "part", {"a": "a", "b": "b"}, 1.0)
    assert session.remaining == 0.0
    units = [{r["unit"] for r in c._views["t"].collect()} for c in children.values()]
    assert not units[0] & units[1] and len(units[0] | units[1]) == 10


def test_budget_is_shared_by_weight(people):
    session = PrivacySession.from_dataframe(people, "people", 1.0, noise=QUIET)
    session.evaluate_all({"n": Query("people").count(), "s": Query("people").sum("age", 0, 120)}, 1.0, {"n": 1, "s": 3})
    assert session._amounts == pytest.approx([0.25, 0.75])


def test_two_phases_in_sessions(spark, people):
    """A coarse release labels the groups; small and large ones go to children with the rest."""
    session = PrivacySession.from_dataframe(people, "people", 40.0, measure="zcdp", noise=QUIET)
    diseases = spark.createDataFrame([("Mumps",), ("Rubella",), ("Typhoid",)], "disease string")
    counts = session.evaluate(Query("people").group_by(diseases).count(), 4.0)
    labelled = counts.selectExpr("disease", "IF(count < 42, 'true', 'false') AS under_threshold")
    session.create_view(Query("people").join_public(labelled, ["disease"]), "labelled_people")
    parts = session.partition_and_spend("labelled_people", "under_threshold", {"small": "true", "large": "false"}, 36.0)
    assert session.remaining == pytest.approx(0.0)
    small = parts["small"].evaluate(Query("labelled_people").group_by(diseases).count(), 36.0).collect()
    assert abs({r["disease"]: r["count"] for r in small}["Mumps"] - 10) <= 2
    ages = spark.range(19, 79).select(F.col("id").cast("int").alias("age"))
    fine = parts["large"].evaluate(Query("labelled_people").group_by(ages).count(), 36.0)
    assert fine.count() == 60 and abs(fine.agg(F.sum("count")).first()[0] - 90) < 30
    rows = session.spends().collect()
    assert [r["rho"] for r in rows] == [4.0, 36.0] and all(r["epsilon"] is None for r in rows)
    assert L.totals(session.spends(), 1.0, "zcdp").first()["rho"] == 40.0


def test_other_statistics_under_zcdp(people):
    session = PrivacySession.from_dataframe(people, "people", 1e12, measure="zcdp", noise=QUIET)
    mean = session.evaluate(Query("people").average("age", 0, 120), 1e12).first()[0]
    assert mean == pytest.approx(people.agg(F.avg("age")).first()[0], abs=1e-3)
    with pytest.raises(ValueError):
        PrivacySession.from_dataframe(people, "people", 1.0, measure="renyi")


def test_ledger_table(spark, people, tmp_path):
    path = str(tmp_path / "ledger")
    for name in ("first", "second"):
        session = PrivacySession.from_dataframe(people, "people", 1.0, noise=QUIET, name=name, ledger_path=path)
        session.evaluate(Query("people").count(), 0.25)
    totals = L.totals(spark.read.schema(L.SPENDS).parquet(path), 1.0).collect()
    assert {r["session"]: r["remaining"] for r in totals} == {"first": 0.75, "second": 0.75}


def test_query_needs_a_statistic(people):
    session = PrivacySession.from_dataframe(people, "people", 1.0, noise=QUIET)
    with pytest.raises(ValueError):
        session.evaluate(Query("people").filter("age > 3"), 0.5)
    with pytest.raises(ValueError):
        session.evaluate(Query("nobody").count(), 0.5)
    with pytest.raises(ValueError):
        session.evaluate(Query("people").count(), 0.0)
    assert len(session) == 0


def _ledger(spark, rows):
    """Rows of session, partition, epsilon, delta, rho; one second apart."""
    at = datetime(2024, 1, 1)
    full = [(s, p, "q", "m", e, dl, r, at + timedelta(seconds=i)) for i, (s, p, e, dl, r) in enumerate(rows)]
    return spark.createDataFrame(full, L.SPENDS)


def test_audits_in_zcdp(spark):
    spends = _ledger(spark, [("a", "x", None, 0.0, 5.0), ("a", "y", 2.0, 0.0, None), ("b", "x", 0.1, 0.0, None)])
    rows = {r["session"]: r for r in L.totals(spends, 1.0, "zcdp").collect()}
    assert (rows["a"]["rho"], rows["a"]["remaining"], rows["a"]["over_limit"]) == (7.0, -6.0, True)
    assert rows["b"]["rho"] == pytest.approx(0.005) and not rows["b"]["over_limit"]
    assert [(r["session"], r["rho"]) for r in L.first_overrun(spends, 6.0, "zcdp").collect()] == [("a", 7.0)]
    assert {r["session"]: r["rho"] for r in L.parallel_compose(spends, "zcdp").collect()}["a"] == 5.0


def test_spends_that_a_measure_cannot_express_are_refused(spark):
    zcdp = _ledger(spark, [("a", "x", None, 0.0, 5.0)])
    approx = _ledger(spark, [("a", "x", 1.0, 1e-3, None)])
    for job in (lambda: L.totals(zcdp, 1.0), lambda: L.first_overrun(zcdp, 1.0), lambda: L.compose_advanced(zcdp, 0.1),
                lambda: L.parallel_compose(zcdp), lambda: L.totals(approx, 1.0, "zcdp")):
        with pytest.raises(Exception, match="spend"):
            job().collect()
    with pytest.raises(ValueError):
        L.totals(zcdp, 1.0, "bits")


def test_conversion_keeps_delta(spark):
    r = L.convert_spends(_ledger(spark, [("a", "x", 1.0, 1e-3, None)]), 1e-6).first()
    assert (r["approx_epsilon"], r["approx_delta"], r["zcdp_rho"]) == (1.0, 1e-3, None)


def test_limits_and_weights_of_any_size(spark):
    spends = _ledger(spark, [("a", "x", 3e6, 0.0, None), ("a", "x", 4e6, 0.0, None)])
    row = L.totals(spends, float("inf")).first()
    assert (row["epsilon"], row["remaining"], row["over_limit"]) == (7e6, float("inf"), False)
    assert L.totals(spends, 6e6).first()["over_limit"] and L.first_overrun(spends, 5e6).first()["epsilon"] == 7e6
    assert L.first_overrun(spends, float("inf")).count() == 0
    plan = spark.createDataFrame([("a", 2e6), ("a", 6e18)], "session string, weight double")
    assert sorted(r["epsilon"] for r in L.split_budget(plan, 1.0).collect()) == [pytest.approx(1 / 3e12), pytest.approx(1.0)]


def _people(spark):
    return spark.range(300).select((F.col("id") % 3).alias("user_id"), F.col("id").alias("event_id"), F.lit(1.0).alias("v"))


def test_steps_cannot_replace_the_unit(spark):
    unit = PrivacyUnit("user_id", rows=1, row_key=("event_id",))
    session = PrivacySession.from_dataframe(_people(spark), "people", 1e12, unit=unit, noise=QUIET)
    for query in (
        Query("people").rename({"user_id": "old", "event_id": "user_id"}),
        Query("people").select("v"),
        Query("people").with_column("user_id", "event_id"),
    ):
        assert session.evaluate(query.count(), 1e9).first()["count"] == 3
    session.create_view(Query("people").rename({"user_id": "old", "event_id": "user_id"}), "derived")
    assert session.evaluate(Query("derived").count(), 1e9).first()["count"] == 3
    assert not spark.catalog.tableExists("derived")


def test_steps_that_look_beyond_one_row_are_refused(spark):
    session = PrivacySession.from_dataframe(_people(spark), "people", 1e12, noise=QUIET)
    for query in (
        Query("people").with_column("x", "explode(sequence(1, 100))"),
        Query("people").with_column("x", "sum(v) over (partition by user_id)"),
        Query("people").filter("v > (select 0)"),
        Query("people").with_column("__private_0", "1"),
    ):
        with pytest.raises(UnsafeStep):
            session.evaluate(query.count(), 1.0)
    some = Query("people").filter("v > 0").with_column("w", "v + 1").drop_missing("w").fill_missing({"w": 0.0})
    assert session.evaluate(some.count(), 1e9).first()["count"] == 300


def test_rows_that_multiply_declare_it(spark):
    session = PrivacySession.from_dataframe(_people(spark), "people", 1e12, noise=QUIET)
    query = Query("people").explode("x", "sequence(1, 100)", 4)
    assert query.influence == 4
    assert session.evaluate(query.count(), 1e9).first()["count"] == 1200


def test_refused_queries_start_no_job(spark):
    class Failing:
        def groupBy(self, *columns):
            raise AssertionError("a job was started")

    session = PrivacySession.from_dataframe(_people(spark), "people", 1.0, noise=QUIET)
    query = Query("people").join_public(Failing(), ["user_id"]).count()
    with pytest.raises(BudgetExceeded):
        session.evaluate(query, 2.0)


VISITS = [(i % 40, i, float(i % 100), "often" if i % 40 < 39 else "rare") for i in range(400)]
VISITOR = PrivacyUnit("person", partitions=2, rows=20, row_key=("visit",))


@pytest.fixture()
def visits(spark):
    return spark.createDataFrame(VISITS, "person int, visit int, hours double, place string")


def test_small_epsilons_compose_with_slack(people):
    """Sixty-four spends of 0.02 add up to 1.28; with a slack of 1e-6 they compose to less."""
    session = PrivacySession.from_dataframe(people, "people", 1.0, measure="approx", delta=1e-6, slack=1e-6, noise=QUIET)
    for _ in range(64):
        session._charge(0.02, "count", "count")
    drift = 64 * 0.02 * (math.exp(0.02) - 1) / (math.exp(0.02) + 1)
    squares = 64 * 0.02**2
    assert session.spent == pytest.approx(drift + math.sqrt(2 * squares * math.log(math.e + math.sqrt(squares) / 1e-6)))
    assert session.remaining_delta == pytest.approx(0.0, abs=1e-15)
    with pytest.raises(BudgetExceeded):
        session.evaluate(Query("people").count(), 0.5)
    exact = PrivacySession.from_dataframe(people, "people", 1.0, measure="approx", noise=QUIET)
    with pytest.raises(BudgetExceeded):
        exact.evaluate(Query("people").count(), 1.28)


def test_slack_agrees_with_the_audit(spark, people):
    session = PrivacySession.from_dataframe(people, "people", 9.0, measure="approx", delta=1e-4, slack=1e-5, noise=QUIET)
    for epsilon, delta in [(0.1, 0.0), (0.3, 1e-6), (0.02, 0.0), (0.7, 2e-5)]:
        session._charge(epsilon, "q", "m", delta=delta)
    audit = L.compose_advanced(session.spends(), 1e-5).first()
    assert session.spent == pytest.approx(audit["epsilon"])
    assert session.spent_delta == pytest.approx(audit["delta"])


def test_delta_is_paid_for(visits):
    session = PrivacySession.from_dataframe(visits, "visits", 100.0, measure="approx", delta=1e-5, unit=VISITOR, noise=QUIET)
    asked = Query("visits").group_by_found(["place"], 6e-6)
    found = session.evaluate(asked.found_keys(), 50.0).collect()
    assert [r["place"] for r in found] == ["often"]
    assert session.spent_delta == pytest.approx(6e-6)
    with pytest.raises(BudgetExceeded, match="delta"):
        session.evaluate(asked.count(), 1.0)
    assert len(session) == 1
    with pytest.raises(ValueError, match="delta"):
        PrivacySession.from_dataframe(visits, "visits", 1.0, unit=VISITOR, noise=QUIET).evaluate(asked.count(), 1.0)


def test_every_statistic_in_a_session(spark, visits):
    """With a huge epsilon each answer is the plain one; each is charged."""
    session = PrivacySession.from_dataframe(visits, "visits", 1e13, noise=QUIET)
    hours, huge = Axis("hours", 0, 100, 10), 1e12

    def ask(query):
        return session.evaluate(query, huge).collect()

    assert ask(Query("visits").count_nonzero("hours"))[0]["count"] == sum(h != 0 for _, _, h, _ in VISITS)
    assert [r["count"] for r in sorted(ask(Query("visits").histogram(hours)))] == [40] * 10
    assert 40 <= ask(Query("visits").quantiles(hours, [0.5]))[0]["value"] <= 60
    assert ask(Query("visits").mean_sized("hours", 0, 100, 400))[0]["mean"] == pytest.approx(49.5, abs=1e-3)
    assert ask(Query("visits").sum_sized("hours", 0, 100, 400))[0]["sum"] == pytest.approx(19800, abs=1e-3)
    assert ask(Query("visits").variance_sized("hours", 0, 100, 400))[0]["variance"] == pytest.approx(833.25, abs=1e-3)
    vectors = Query("visits").with_column("v", "array(hours / 100, 1.0)").vector_sum("v", 2, 2.0)
    assert [r["value"] for r in sorted(ask(vectors))] == pytest.approx([198.0, 400.0], abs=1e-3)
    both = ask(Query("visits").aggregate(["count", "mean"], "hours", 0, 100))[0]
    assert both["count"] == 400 and both["mean"] == pytest.approx(49.5, abs=1e-3)
    assert len(session) == 8 and session.spent == 8e12


def test_sized_statistics_of_rows_that_multiply(spark, visits):
    """A row that may count four times gets four times the noise, from the same draw."""
    def noise_of(copies):
        session = PrivacySession.from_dataframe(visits, "visits", 1.0, noise=QUIET)
        query = Query("visits").explode("copy", "array(1)", copies).drop_missing("copy")
        return session.evaluate(query.sum_sized("hours", 0, 100, 400), 1.0).first()["sum"] - 19800

    assert noise_of(4) == pytest.approx(4 * noise_of(1))


def test_gaussian_answers_need_a_rho_or_a_delta(spark, visits):
    vectors = Query("visits").with_column("v", "array(hours / 100, 1.0)")
    pure = PrivacySession.from_dataframe(visits, "visits", 1e9, noise=QUIET)
    with pytest.raises(ValueError, match="Gaussian"):
        pure.evaluate(vectors.vector_sum("v", 2, 2.0, "l2"), 1.0)
    assert len(pure) == 0
    approx = PrivacySession.from_dataframe(visits, "visits", 1e13, measure="approx", delta=1e-5, noise=QUIET)
    answer = approx.evaluate(vectors.vector_sum("v", 2, 2.0, "l2", 1e-6), 1e12).collect()
    assert [r["value"] for r in sorted(answer)] == pytest.approx([198.0, 400.0], abs=1e-2)
    rho = C.approx_to_zcdp(2.0, 1e-6)
    back = spark.range(1).select(C.zcdp_to_epsilon(F.lit(rho), 1e-6)).first()[0]
    assert back == pytest.approx(2.0)


def test_unanswerable_queries_cost_nothing(visits):
    rows = PrivacySession.from_dataframe(visits, "visits", 1.0, measure="approx", delta=0.1, noise=QUIET)
    people = PrivacySession.from_dataframe(visits, "visits", 1.0, measure="approx", delta=0.1, unit=VISITOR, noise=QUIET)
    q, axis = Query("visits"), Axis("hours", 0, 100, 10)
    for session, query in [
        (rows, q.group_by_found(["place"], 0.01).count()), (rows, q.privacy_id_count()), (people, q.found_keys()),
        (people, q.mean_sized("hours", 0, 100, 400)), (people, q.group_by_found(["place"], 0.01).histogram(axis)),
        (people, q.group_by_found(["place"], 0.01).quantiles(axis, [0.5])),
    ]:
        with pytest.raises(ValueError):
            session.evaluate(query, 0.5)
    assert len(rows) == 0 and len(people) == 0
    for options in ({"delta": 0.1}, {"measure": "approx", "slack": 0.1}, {"measure": "approx", "delta": 1.0}):
        with pytest.raises(ValueError):
            PrivacySession.from_dataframe(visits, "visits", 1.0, noise=QUIET, **options)


def test_a_session_resumes_from_its_ledger(people, tmp_path):
    path = str(tmp_path / "ledger")
    options = {"noise": QUIET, "name": "study", "ledger_path": path}
    first = PrivacySession.from_dataframe(people, "people", 1.0, **options)
    first.evaluate(Query("people").count(), 0.75)
    first.partition_and_spend("people", "disease", {"m": "Mumps", "r": "Rubella"}, 0.125)["m"].evaluate(Query("people").count(), 0.125)
    again = PrivacySession.from_dataframe(people, "people", 1.0, **options)
    assert again.remaining == 0.125 and len(again) == 2
    with pytest.raises(BudgetExceeded):
        again.evaluate(Query("people").count(), 0.25)
    other = PrivacySession.from_dataframe(people, "people", 1.0, **{**options, "name": "other"})
    assert other.remaining == 1.0
    rho = PrivacySession.from_dataframe(people, "people", 1.0, measure="zcdp", **options)
    assert rho.spent == 0.75**2 / 2 + 0.125**2 / 2


def test_close_removes_exact_tables(spark, people):
    """The cells of a two-phase count go, its release stays."""
    diseases = spark.createDataFrame([("Mumps",), ("Rubella",)], "disease string")
    fine = spark.createDataFrame([(d, a) for d in ("Mumps", "Rubella") for a in range(19, 79)], "disease string, age int")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir())
    with PrivacySession.from_dataframe(people, "people", 1e9, measure="zcdp", noise=SecureNoise()) as session:
        answer = session.evaluate(Query("people").two_phase_count(diseases, fine, 50.0), 1e9)
        held = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
        assert "cells" in held
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert left == {"release"}
    assert sum(r["count"] for r in answer.collect()) == 100
