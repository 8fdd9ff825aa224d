"""Steps that depend on chance or place, ledgers that several sessions charge, and spends too small to see."""

from __future__ import annotations

import subprocess
import sys
import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hushframe.functions.noise import SeededNoise
from hushframe.operators.histograms import Axis
from hushframe.plans import ledger as L
from hushframe.plans.charges import Charges
from hushframe.plans.session import BudgetExceeded, PrivacySession, Query, UnsafeStep

QUIET = SeededNoise(3)


@pytest.fixture
def rows(spark):
    return spark.range(300).select(F.col("id"), (F.col("id") % 7).cast("double").alias("v"), F.lit("a b").alias("s"))


UNSTABLE = [
    "monotonically_increasing_id() % 2 * 10", "rand(3)", "randn(1)", "length(uuid())", "spark_partition_id()",
    "length(input_file_name())", "input_file_block_start()", "shuffle(array(v, 1.0))[0]", "uniform(0, 10, 3)",
    "length(randstr(5, 1))", "if(v > 1, monotonically_increasing_id(), 0)", "length(reflect('java.util.UUID', 'randomUUID'))",
]


@pytest.mark.parametrize("expression", UNSTABLE)
def test_position_and_chance_are_refused(rows, expression):
    session = PrivacySession.from_dataframe(rows, "rows", 1e12, noise=QUIET)
    for query in (
        Query("rows").with_column("x", expression).sum("x", 0, 10),
        Query("rows").filter(f"({expression}) >= 0").count(),
        Query("rows").explode("x", f"array({expression})", 2).count(),
        Query("rows").select(F.expr(expression).alias("x")).sum("x", 0, 10),
    ):
        with pytest.raises(UnsafeStep):
            session.evaluate(query, 1.0)


def test_a_row_that_is_filtered_away_moves_nothing(rows):
    """With numbers by place, leaving out a filtered row would move every other row's value."""
    session = PrivacySession.from_dataframe(rows, "rows", 1e12, noise=QUIET)
    query = Query("rows").filter("id <> 0").with_column("x", "monotonically_increasing_id() % 2 * 10")
    with pytest.raises(UnsafeStep):
        session.evaluate(query.sum("x", 0, 10), 1.0)


def test_foreign_functions_are_refused(spark, rows):
    spark.udf.register("python_one", lambda v: 1.0, "double")
    session = PrivacySession.from_dataframe(rows, "rows", 1e12, noise=QUIET)
    for expression in ("python_one(v)", "1 + coalesce(python_one(v), 0)"):
        with pytest.raises(UnsafeStep, match="functions of Spark"):
            session.evaluate(Query("rows").with_column("x", expression).sum("x", 0, 10), 1.0)


def test_statistics_take_names_of_columns(rows):
    session = PrivacySession.from_dataframe(rows, "rows", 1e12, noise=QUIET)
    place = F.monotonically_increasing_id()
    for query in (
        Query("rows").sum(place, 0, 10), Query("rows").average(place, 0, 10), Query("rows").count_nonzero(place % 2),
        Query("rows").sum_sized(place, 0, 10, 300), Query("rows").vector_sum(F.array(place), 1, 10.0),
        Query("rows").histogram(Axis(place, 0, 10, 5)), Query("rows").quantiles(Axis(place, 0, 10, 5), [0.5]),
    ):
        with pytest.raises(UnsafeStep):
            session.evaluate(query, 1.0)
    assert len(session) == 0


def test_plain_steps_pass(rows):
    session = PrivacySession.from_dataframe(rows, "rows", 1e12, noise=QUIET)
    steps = Query("rows").select("id", "v", "s").rename({"v": "w"}).with_column("x", "sqrt(w) + length(s) + size(filter(array(w, 1), y -> y > 0))")
    steps = steps.filter("x > 0 and s rlike 'a'").explode("word", "split(s, ' ')", 2).filter("word = 'a'")
    assert session.evaluate(steps.count(), 1e9).first()["count"] == 300


def options(path, **more):
    return {"noise": QUIET, "name": "shared", "ledger_path": str(path), **more}


def test_two_open_sessions_do_not_overspend(rows, tmp_path):
    first, second = (PrivacySession.from_dataframe(rows, "rows", 1.0, **options(tmp_path / "l")) for _ in range(2))
    first.evaluate(Query("rows").count(), 0.75)
    with pytest.raises(BudgetExceeded):
        second.evaluate(Query("rows").count(), 0.75)
    assert (second.spent, len(second)) == (0.75, 1)
    second.evaluate(Query("rows").count(), 0.25)
    with pytest.raises(BudgetExceeded):
        first.evaluate(Query("rows").count(), 0.125)
    first.refresh()
    assert first.remaining == 0.0 and len(first) == 2
    files = sorted(p.name for p in (tmp_path / "l").iterdir() if p.name.startswith("charge-") and p.suffix == ".parquet")
    assert len(files) == 2 and not [p for p in (tmp_path / "l").iterdir() if p.name.endswith(".tmp")]


def test_many_sessions_at_once(spark, rows, tmp_path):
    """Of 24 charges of 1/16 by eight threads, 16 fit."""
    paid, refused = [], []

    def work():
        session = PrivacySession.from_dataframe(rows, "rows", 1.0, **options(tmp_path / "l"))
        for _ in range(3):
            try:
                session._charge_all([(0.0625, "q", "m", "all", 0.0)])
                paid.append(1)
            except BudgetExceeded:
                refused.append(1)

    threads = [threading.Thread(target=work) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert (len(paid), len(refused)) == (16, 8)
    total = L.totals(spark.read.schema(L.SPENDS).parquet(str(tmp_path / "l")), 1.0).first()
    assert (total["epsilon"], total["spends"], total["over_limit"]) == (1.0, 16, False)


def test_a_batch_is_paid_for_together(rows, tmp_path):
    first, second = (PrivacySession.from_dataframe(rows, "rows", 1.0, **options(tmp_path / "l")) for _ in range(2))
    first.evaluate(Query("rows").count(), 0.5)
    with pytest.raises(BudgetExceeded):
        second.evaluate_all({"a": Query("rows").count(), "b": Query("rows").sum("v", 0, 7)}, 0.75)
    assert len(second) == 1 and second.remaining == 0.5


def test_names_do_not_disturb_each_other(rows, tmp_path):
    for name in ("a", "b", "a/b"):
        session = PrivacySession.from_dataframe(rows, "rows", 1.0, **options(tmp_path / "l", name=name))
        session.evaluate(Query("rows").count(), 1.0)
    again = PrivacySession.from_dataframe(rows, "rows", 2.0, **options(tmp_path / "l", name="a/b"))
    assert again.spent == 1.0


def test_children_are_paid_for_by_their_parent(rows, tmp_path):
    parent = PrivacySession.from_dataframe(rows, "rows", 1.0, **options(tmp_path / "l"))
    for _ in range(2):  # the same part twice: each time with a budget of its own
        child = parent.partition_and_spend("rows", "v", {"three": 3.0}, 0.25)["three"]
        child.evaluate(Query("rows").count(), 0.25)
        with pytest.raises(BudgetExceeded):
            child.evaluate(Query("rows").count(), 0.125)
    assert parent.remaining == 0.5


def test_charges_elsewhere_than_on_a_local_disk(spark, tmp_path, monkeypatch):
    """The rename that other file systems use does not replace a number that is taken either."""
    charges = [Charges(spark, str(tmp_path / "l"), "n") for _ in range(2)]
    row = ("n", "all", "q", "m", 0.5, 0.0, None, datetime(2024, 1, 1))
    for c in charges:
        fs = c._fs

        class Remote:
            def __getattr__(self, name):
                return getattr(fs, name)

            def getScheme(self):
                return "elsewhere"

        c._fs = Remote()
    assert charges[0].write([row])
    assert not charges[1].write([row])
    assert [r[:5] for r in charges[1].read_next()] == [row[:5]]
    assert charges[1].read_next() is None and charges[1].write([row, row])
    assert len(charges[0].read_next()) == 2


def test_old_ledgers_are_read(spark, rows, tmp_path):
    """A table of spends written by Spark counts like numbered charges."""
    spend = [("shared", "all", "q", "m", 0.5, 0.0, None, datetime(2024, 1, 1))]
    spark.createDataFrame(spend, L.SPENDS).coalesce(1).write.parquet(str(tmp_path / "l"))
    session = PrivacySession.from_dataframe(rows, "rows", 1.0, **options(tmp_path / "l"))
    session.evaluate(Query("rows").count(), 0.25)
    again = PrivacySession.from_dataframe(rows, "rows", 1.0, **options(tmp_path / "l"))
    assert again.remaining == 0.25 and len(again) == 2


def test_small_spends_do_not_vanish(spark):
    spends = spark.range(100_000).select(
        F.lit("s").alias("session"), F.lit("p").alias("partition"), F.lit("q").alias("query"), F.lit("m").alias("mechanism"),
        F.lit(9e-7).alias("epsilon"), F.lit(0.0).alias("delta"), F.lit(None).cast("double").alias("rho"),
        F.lit(datetime(2024, 1, 1)).alias("ts"),
    )
    row = L.totals(spends, 1e-9, "zcdp").first()
    true = 100_000 * 9e-7**2 / 2
    assert true <= row["rho"] <= true + 100_000 * 1e-12 and row["over_limit"]
    assert L.first_overrun(spends, 1e-9, "zcdp").count() == 1
    assert L.parallel_compose(spends, "zcdp").first()["rho"] == row["rho"]


def test_what_has_twelve_places_stays_as_it_is(spark):
    at = datetime(2024, 1, 1)
    values = [0.1, 0.07, 1e-12, 1234.000000000001, 0.25]
    spends = spark.createDataFrame([(str(i), "p", "q", "m", v, 0.0, None, at) for i, v in enumerate(values)], L.SPENDS)
    assert [r["epsilon"] for r in L.totals(spends, 1.0).orderBy("session").collect()] == values
