"""Private aggregates: sensitivities on neighbouring tables, empty groups, refused arguments."""

from __future__ import annotations

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hushframe.functions.noise import SecureNoise, SeededNoise
from hushframe.operators import bounding as B
from hushframe.operators import histograms as H
from hushframe.operators import private as P
from hushframe.operators.bounding import ROW, PrivacyUnit, bound_contributions
from hushframe.operators import vectors as V
from hushframe.operators.vectors import dp_vector_sum, vector_sum
from hushframe.plans.adaptive import two_phase_count

QUIET = SeededNoise(1)
HUGE = 1e9


@pytest.fixture(scope="module")
def table(spark):
    unit = F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(25)))
    return spark.range(900).select(
        "id", unit.alias("unit"), (F.col("id") % 5).cast("string").alias("kind"), (F.col("id") % 40 - 10.0).alias("v")
    )


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([(str(k),) for k in range(7)], "kind string")


@pytest.mark.parametrize(("rows", "partitions"), [(1, 1), (1, 2), (3, 2), (4, 5)])
def test_one_unit_moves_the_moments_by_at_most_the_sensitivity(table, keys, rows, partitions):
    unit = PrivacyUnit("unit", partitions=partitions, rows=rows, row_key=("id",))
    low, high = -4.0, 20.0
    metrics = ["count", "privacy_id_count", "sum", "variance"]

    def moments(df):
        exact = P._moments(df, metrics, "v", low, high, ["kind"], keys, None, unit, None)
        return {r["kind"]: r for r in exact.collect()}

    whole = moments(table)
    assert set(whole) == {str(k) for k in range(7)}
    limits = {d.column: d.scale for d in P._draws(metrics, dict.fromkeys(metrics, 1.0), low, high, ["kind"], unit, "geometric", None)}
    for gone in (0, 3, 11):
        less = moments(table.filter(F.col("unit") != gone))
        for column, scale in limits.items():
            share = 1.0 / len(P.MOMENTS[column.rsplit("_", 1)[0]])
            moved = sum(abs(whole[k][column] - less[k][column]) for k in whole)
            assert moved <= scale * share + 1e-9, column


def test_answers_without_noise(table, keys):
    options = {"value": "v", "low": -100, "high": 100, "by": ["kind"], "keyset": keys}
    answer = P.dp_aggregate(table, list(P.METRICS[:1]) + ["sum", "mean", "variance", "std"], HUGE, QUIET, **options)
    got = {r["kind"]: r for r in answer.collect()}
    truth = {
        r["kind"]: r
        for r in table.groupBy("kind").agg(
            F.count("*").alias("count"), F.sum("v").alias("sum"), F.avg("v").alias("mean"),
            F.var_pop("v").alias("variance"), F.stddev_pop("v").alias("std"),
        ).collect()
    }
    for kind, row in truth.items():
        for c in ("count", "sum", "mean", "variance", "std"):
            assert got[kind][c] == pytest.approx(row[c], abs=1e-4)
    assert got["6"]["count"] == 0 and got["6"]["sum"] == pytest.approx(0, abs=1e-4)


def test_sample_variance(table):
    answer = P.dp_variance(table, "v", -100, 100, HUGE, QUIET, ddof=1).first()[0]
    assert answer == pytest.approx(table.agg(F.var_samp("v")).first()[0], abs=1e-4)


def test_grid_sum_is_exact(table):
    expected = table.agg(F.sum(F.greatest(F.least("v", F.lit(20.0)), F.lit(-4.0)))).first()[0]
    assert P.dp_sum(table, "v", -4, 20, HUGE, QUIET, grid=0.5).first()[0] == expected


def test_grid_sensitivity_covers_rounding_up():
    draw, = P._draws(["sum"], {"sum": 1.0}, 0, 2.5, (), ROW, "geometric", 1.0)
    assert draw.scale == 3.0  # 2.5 rounds up to three steps


def test_empty_table(table):
    row = P.dp_aggregate(table.limit(0), ["count", "sum", "mean", "std"], HUGE, QUIET, value="v", low=0, high=10).first()
    assert row["count"] == 0 and row["sum"] == pytest.approx(0, abs=1e-4)
    assert 0 <= row["mean"] <= 10 and 0 <= row["std"] <= 5


def test_null_key_and_repeated_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0)], "k string, v double")
    keys = spark.createDataFrame([(None,), ("a",), ("a",)], "k string")
    rows = P.dp_aggregate(df, ["count"], HUGE, QUIET, by=["k"], keyset=keys).collect()
    assert sorted((str(r["k"]), r["count"]) for r in rows) == [("None", 2), ("a", 1)]


def test_secure_answers(table, keys):
    answer = P.dp_aggregate(
        table, ["count", "mean"], 5.0, SecureNoise(), value="v", low=-10, high=30, by=["kind"], keyset=keys
    )
    assert sorted(answer.collect()) == sorted(answer.collect())
    assert all(-10 <= r["mean"] <= 30 for r in answer.collect())


def test_privacy_id_count(table, keys):
    unit = PrivacyUnit("unit", partitions=5, row_key=("id",))
    got = {r["kind"]: r[1] for r in P.dp_privacy_id_count(table, unit, HUGE, QUIET, by=["kind"], keyset=keys).collect()}
    truth = {r["kind"]: r[1] for r in table.groupBy("kind").agg(F.countDistinct("unit")).collect()}
    assert got == {**dict.fromkeys(map(str, range(7)), 0), **truth}
    assert P.dp_privacy_id_count(table, unit, HUGE, QUIET).first()[0] == table.select("unit").distinct().count()


def test_selection_removes_small_groups(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 490, "large").otherwise(F.col("id").cast("string")).alias("k"))
    unit = PrivacyUnit("id")
    kept = P.select_partitions(df, unit, ["k"], 2.0, 1e-6, SeededNoise(4)).collect()
    assert [r["k"] for r in kept] == ["large"]
    both = P.dp_aggregate(df, ["count"], 2.0, SeededNoise(4), by=["k"], selection=(2.0, 1e-6), unit=unit).collect()
    assert [r["k"] for r in both] == ["large"]


def test_count_nonzero(table):
    assert P.dp_count_nonzero(table, "v", HUGE, QUIET).first()[0] == table.filter("v <> 0").count()
    share = P.dp_count_nonzero(table, F.col("v") >= 5, HUGE, QUIET, n=900).first()
    assert share["share"] == pytest.approx(table.filter("v >= 5").count() / 900)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (2.0,), (-1.0,), (10.5,), (None,), (float("nan"),)], "v double")
    rows = H.dp_histogram(df, "v", 0, 10, 5, HUGE, QUIET).collect()
    assert [r["count"] for r in sorted(rows, key=lambda r: r["bin_0"])] == [1, 1, 0, 0, 2]


def test_fine_grids(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double")
    fine = H.dp_histogram(df, "v", 0, 1, 10_000_001, HUGE, SeededNoise(1))
    row = fine.agg(F.count("*").alias("cells"), F.sum("count").alias("n")).first()
    assert (row["cells"], row["n"]) == (10_000_001, 3)
    huge = H.Axis("v", 0, 1, 1 << 40)
    with pytest.raises(ValueError):
        H.full_grid(df, [huge, huge])
    assert H.full_grid(df, [huge]).limit(1).count() == 1


def test_quantiles_of_several_blocks(spark):
    df = spark.range(50_000).select((F.col("id") % 1000 / 10.0).alias("v"), (F.col("id") % 2).alias("k"))
    keys = spark.createDataFrame([(0,), (1,), (None,)], "k long")
    axis = H.Axis("v", 0, 100, 3 * H.BLOCK + 5)
    got = {r["quantile"]: r["value"] for r in H.dp_quantiles(df, axis, [0.2, 0.7], 8.0, QUIET).collect()}
    assert all(abs(got[q] - 100 * q) < 1 for q in got)
    rows = H.dp_quantiles(df, axis, [0.5], 8.0, QUIET, by=["k"], keyset=keys).collect()
    assert {r["k"] for r in rows} == {0, 1, None} and all(abs(r["value"] - 50) < 1 for r in rows if r["k"] is not None)


def test_vector_elements_that_are_no_numbers(spark):
    """By brute force: leaving out any one vector moves the sum by the clip at most."""
    nan, inf = float("nan"), float("inf")
    rows = [[1e9, None], [nan, 1e9], [inf, 1.0], [1e200, 1e200], [0.3, 0.4, 1e9], [2.0], [], None, [0.0, 0.0], [-inf, nan]]
    for norm in ("l1", "l2"):
        def total(vectors):
            df = spark.createDataFrame([(v,) for v in vectors], "v array<double>")
            return {r["pos"]: r["value"] for r in V.vector_sum(df, "v", 2, 1.0, norm).collect()}

        whole = total(rows)
        assert set(whole) == {0, 1} and all(abs(x) < 100 for x in whole.values())
        for i in range(len(rows)):
            less = total(rows[:i] + rows[i + 1 :])
            gaps = [abs(whole[p] - less[p]) for p in whole]
            length = sum(gaps) if norm == "l1" else sum(g * g for g in gaps) ** 0.5
            assert length <= 1 + 1e-9
    assert total([[0.3, 0.4, 1e9]]) == {0: 0.3, 1: 0.4}


def test_counts_take_calibrated_noise_only(table):
    with pytest.raises(ValueError):
        P.dp_count(table, 1.0, QUIET, count_mechanism="discrete_gaussian")
    assert P.dp_count(table, 1.0, QUIET, count_mechanism="laplace").count() == 1


def test_secure_release_writes_released_keys_only(spark):
    """Twelve keys are found, two are frequent enough: no other key reaches the disk."""
    rows = [(f"rare{i}", i) for i in range(10)] + [(k, 1000 + j) for k in ("often", "also") for j in range(500)]
    df = spark.createDataFrame(rows, "k string, id long")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir())
    unit = PrivacyUnit("id")
    found = P.select_partitions(df, unit, ["k"], 5.0, 1e-5, SecureNoise()).collect()
    P.dp_aggregate(df, ["count"], 5.0, SecureNoise(), by=["k"], selection=(5.0, 1e-5), unit=unit).collect()
    assert {r["k"] for r in found} == {"often", "also"}
    written = [spark.read.parquet(str(p)) for p in set(folder.iterdir()) - before]
    assert len(written) == 2 and all({r["k"] for r in w.select("k").collect()} == {"often", "also"} for w in written)


def test_same_row_kept_in_any_order(spark):
    """Rows that share a row key: the file's order never decides which one stays."""
    rows = [(u, 1, float(v)) for u in range(20) for v in (0, 3, 7, 11)]
    unit = PrivacyUnit("u", row_key=("k",))
    sums = set()
    for turn in range(4):
        df = spark.createDataFrame(rows[turn * 7 :] + rows[: turn * 7], "u int, k int, v double").repartition(turn + 1)
        kept = B.one_value_each(df, "v", unit).agg(F.sum("v")).first()[0]
        listed = B.bound_contributions(df, unit).agg(F.sum("v")).first()[0]
        sums.add((kept, listed))
    assert len(sums) == 1


def test_quantiles_near_the_truth(spark):
    df = spark.range(20_000).select((F.col("id") % 1000 / 10.0).alias("v"))
    axis = H.Axis("v", 0, 200, 200)
    for source in (QUIET, SecureNoise()):
        got = {r["quantile"]: r["value"] for r in H.dp_quantiles(df, axis, [0.1, 0.5, 0.9], 3.0, source).collect()}
        assert all(abs(got[q] - 100 * q) < 3 for q in got)


def test_vector_clipping(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.3, 0.4],), ([0.0, 0.0],), (None,)], "e array<float>")
    l2 = {r["pos"]: r["value"] for r in vector_sum(df, "e", 3, 1.0).collect()}
    assert l2 == pytest.approx({0: 0.9, 1: 1.2, 2: 0.0}, abs=1e-6)
    l1 = {r["pos"]: r["value"] for r in vector_sum(df, "e", 2, 0.7, "l1").collect()}
    assert l1 == pytest.approx({0: 0.6, 1: 0.8}, abs=1e-6)
    noisy = dp_vector_sum(df, "e", 2, 1.0, 1e12, QUIET).collect()
    assert {r["pos"]: r["value"] for r in noisy} == pytest.approx({0: 0.9, 1: 1.2}, abs=1e-4)


def test_long_vectors_do_not_leak_coordinates(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],)], "e array<double>")
    assert {r["pos"] for r in vector_sum(df, "e", 2, 9.0).collect()} == {0, 1}


def test_zcdp_count(spark, table, keys):
    rows = P.dp_group_count(table, keys, ["kind"], 1e6, QUIET, measure="zcdp").collect()
    assert {r["kind"]: r["count"] for r in rows} == {**dict.fromkeys(map(str, range(5)), 180), "5": 0, "6": 0}


def test_bounded_units_in_grids(table, keys):
    unit = PrivacyUnit("unit", partitions=2, rows=3, row_key=("id",))
    axis = H.Axis("v", -10, 30, 4)
    counts = H.dp_histogramdd(table, [axis], HUGE, QUIET, unit=unit)
    assert counts.agg(F.sum("count")).first()[0] == 3 * table.select("unit").distinct().count()
    medians = H.dp_median(table, axis, HUGE, QUIET, unit=unit, by=["kind"], keyset=keys)
    assert medians.count() == 7
    assert all(-10 <= r["value"] <= 30 for r in medians.collect())


def test_two_phases_with_units(spark, table, keys):
    fine = keys.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    df = table.withColumn("half", (F.col("v") > 9).cast("int"))
    unit = PrivacyUnit("unit", rows=20, row_key=("id",))
    rows = two_phase_count(df, keys, ["kind"], fine, ["kind", "half"], 1e9, 50, QUIET, unit=unit).collect()
    kept = bound_contributions(df, unit, ["kind"])
    coarse = {r["kind"]: r["count"] for r in kept.groupBy("kind").count().collect()}
    assert {r["kind"] for r in rows} == {str(k) for k in range(7)}
    for r in rows:
        if r["under_threshold"] == "true":
            assert r["half"] is None and r["count"] == coarse.get(r["kind"], 0) < 50
        else:
            assert coarse[r["kind"]] >= 50
    large = sum(r["count"] for r in rows if r["under_threshold"] == "false")
    assert large == sum(n for n in coarse.values() if n >= 50)
    with pytest.raises(ValueError):
        two_phase_count(df, keys, ["kind"], fine, ["kind", "half"], 1.0, 50, QUIET, unit=PrivacyUnit("unit", 2))


def test_threshold():
    from hushframe.functions.calibration import selection_threshold

    assert selection_threshold(1.0, 1e-5) == pytest.approx(1 - math.log(2e-5))
    two = selection_threshold(1.0, 1e-5, 2)
    assert two == pytest.approx(1 - 2 * math.log(2 * (1 - math.sqrt(1 - 1e-5))), rel=1e-9)
    with pytest.raises(ValueError):
        selection_threshold(1.0, 0.0)


@pytest.mark.parametrize(
    "call",
    [
        lambda t: P.dp_aggregate(t, ["median"], 1.0, QUIET),
        lambda t: P.dp_aggregate(t, ["sum"], 1.0, QUIET),
        lambda t: P.dp_sum(t, "v", 5, 5, 1.0, QUIET),
        lambda t: P.dp_count(t, 1.0, QUIET, by=["kind"]),
        lambda t: P.dp_count(t, 0.0, QUIET),
        lambda t: P.dp_count(t, -1.0, QUIET),
        lambda t: P.dp_aggregate(t, ["privacy_id_count"], 1.0, QUIET, unit=ROW),
        lambda t: P.dp_count(t, 1.0, QUIET, by=["kind"], selection=(1.0, 1e-5), unit=PrivacyUnit(rows=2)),
        lambda t: P.select_partitions(t, ROW, ["kind"], 1.0, 1e-5, QUIET),
        lambda t: H.Axis("v", 0, 1, 0),
        lambda t: H.dp_quantiles(t, H.Axis("v", 0, 1, 5), [1.5], 1.0, QUIET),
    ],
)
def test_refused(table, call):
    with pytest.raises(ValueError):
        call(table)
