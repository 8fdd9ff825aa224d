from __future__ import annotations

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hushframe.functions import scalars as S
from hushframe.operators import ids as I
from hushframe.operators import keysets as K
from hushframe.plans import evaluation as E
from hushframe.plans import materialise as M
from hushframe.functions.noise import SeededNoise
from hushframe.sources import generators as G
from hushframe.sources import results as R
from hushframe.sources import tables as T
from workload import REGISTRY


def test_folder_of_files(spark, tmp_path):
    folder = tmp_path / "size_3" / "my_data_set"
    folder.mkdir(parents=True)
    (folder / "data_3_50_0.csv").write_text("values\n1.5\n2.5\n3.5\n")
    (folder / "data_3_250_5.csv").write_text("values\n10\n20\n30\n")
    (folder / "notes.txt").write_text("values\n99\n")
    df = T.read_dataset_dir(spark, str(tmp_path), "values double").withColumns(T.dataset_features())
    got = df.groupBy("dataset", "dataset_size", "dataset_scale", "dataset_skew").agg(F.sum("values")).collect()
    assert sorted(tuple(r) for r in got) == [("data_3_250_5.csv", 3, 250, 5, 60.0), ("data_3_50_0.csv", 3, 50, 0, 7.5)]


def test_numeric_lines(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text("values\n1\n -2.5 \nabc\n\n3e2\n")
    assert sorted(r["value"] for r in T.read_numeric_lines(spark, str(path)).collect()) == [-2.5, 1.0, 300.0]


def test_split_and_cast(spark):
    lines = spark.createDataFrame([("1|x|2.5",), ("2|y",)], "value string")
    rows = T.split_lines(lines, ["a", "b", "c"], "|")
    assert [tuple(r) for r in rows.collect()] == [("1", "x", "2.5"), ("2", "y", None)]
    numbers = T.select_cast(rows, "c", "double", 0.0)
    assert [r["c"] for r in numbers.collect()] == [2.5, 0.0]


def test_csv_needs_a_schema(spark):
    with pytest.raises(ValueError):
        T.read_table(spark, "/nowhere/x.csv")


def test_missing_values(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 7.0), (4, -3.0)], "id int, x double")
    clamped = {r["id"]: r["c"] for r in df.withColumn("c", S.clamp("x", 0, 5)).collect()}
    assert clamped == {1: None, 2: None, 3: 5.0, 4: 0.0}
    assert [r["id"] for r in S.drop_missing(df, ["x"]).collect()] == [3, 4]
    assert [r["x"] for r in S.fill_missing(df, {"x": 0.5}).collect()] == [0.5, 0.5, 7.0, -3.0]


def test_small_scalars(spark):
    df = spark.createDataFrame([(2.5, 0.0), (3.5, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.half_even("a", 0)).collect()] == [2.0, 4.0]
    rows = df.withColumns(S.error_columns("b", "a", F.lit(10.0))).collect()
    assert [(r["error"], r["relative_error"], r["scaled_error"]) for r in rows] == [(2.5, None, 0.25), (1.5, 0.75, 0.15)]
    assert [r[0] for r in df.select(S.flag("a > 3")).collect()] == [0, 1]
    assert [r[0] for r in df.select(S.grid_steps("a", 0.5)).collect()] == [5, 7]


def test_ids(spark):
    df = spark.range(1000, numPartitions=7).filter("id % 3 = 0").select((F.col("id") % 5).alias("v"))
    numbered = I.with_line_number(df)
    assert sorted(r["id"] for r in numbered.collect()) == list(range(1, 335))
    assert I.with_privacy_id(df).select("id").distinct().count() == 334
    unique = I.with_unique_id(df)
    assert unique.count() == 334 and unique.select("id").distinct().count() == 334
    assert unique.groupBy("v").count().orderBy("v").collect() == df.groupBy("v").count().orderBy("v").collect()


def _written(spark, folder) -> int:
    return sum(1 for f in Path(folder).rglob("*.parquet"))


def test_line_numbers_of_files_write_nothing(spark, tmp_path):
    """Rows of Parquet files are numbered by file name and place, the same each time; other tables as before."""
    path = str(tmp_path / "rows")
    spark.range(1000, numPartitions=9).filter("id >= 30").write.parquet(path)
    shared = spark.conf.get("spark.checkpoint.dir")
    files, before = spark.read.parquet(path), _written(spark, shared)
    numbered = I.with_line_number(files.withColumn("_metadata", F.lit(1)).select((F.col("id") * 2).alias("twice")), "n")
    first = numbered.collect()
    assert _written(spark, shared) == before
    assert sorted(r["n"] for r in first) == list(range(1, 971))
    assert sorted(first) == sorted(numbered.repartition(3).collect())
    assert [r["twice"] for r in sorted(first, key=lambda r: r["n"])] == list(range(60, 2000, 2))
    for other in (files.filter("id % 2 = 0"), files.select(F.explode(F.array("id", "id")).alias("id")), files.limit(7),
                  files.union(files), files.orderBy("id")):
        ids = sorted(r["line"] for r in I.with_line_number(other, "line").collect())
        assert ids == list(range(1, other.count() + 1))
    files.write.csv(str(tmp_path / "text"))
    text = spark.read.schema("id bigint").csv(str(tmp_path / "text"))
    assert sorted(r["line"] for r in I.with_line_number(text, "line").collect()) == list(range(1, 971))
    assert I.with_line_number(spark.read.parquet(path).limit(0)).count() == 0


def test_id_statistics(spark):
    """Repeated, negative, far and null ids; one group per 64 neighbours, no group per id."""
    ids = [0, 63, 64, 64, -1, -64, -65, 2**62, None]
    df = spark.createDataFrame([(i, 5) for i in ids], "a bigint, b int")
    got = {r["name"]: tuple(r)[1:] for r in I.id_statistics(df, ["a", "b"]).collect()}
    assert got == {"a": (8, -65, 2**62, 7), "b": (9, 5, 5, 1)}
    assert I.id_statistics(df.limit(0), ["a", "b"]).count() == 0
    plan = REGISTRY["privacy_ids"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and "Expand" not in plan


def test_a_run_tried_again_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "results")
    schema = "query string, mechanism string, dataset_size bigint, n bigint"
    one = spark.createDataFrame([("A", "m", 1, 5), ("A", None, 2, 6)], schema)
    other = spark.createDataFrame([("A", "m", 1, 5)], schema)
    R.append_results(one, path, "night-1")
    R.append_results(other, path, "night-2")
    R.append_results(one, path, "night-1")
    assert sorted(r["n"] for r in R.read_results(spark, path, schema).collect()) == [5, 5, 6]
    R.append_results(one.filter("n = 6"), path, "night-1")
    left = R.read_results(spark, path, schema + ", run_id string").collect()
    assert sorted((r["run_id"], r["n"]) for r in left) == [("night-1", 6), ("night-2", 5)]
    R.append_results(other, path)
    R.append_results(other, path)
    assert R.read_results(spark, path, schema).count() == 4
    with pytest.raises(ValueError):
        R.append_results(one, path, "../elsewhere")


def test_keysets(spark):
    a = spark.createDataFrame([(1,), (None,)], "a int")
    b = spark.createDataFrame([("x", 1.5), (None, 2.5)], "b string, c double")
    assert K.keyset_product(a, b).count() == 4
    assert K.keyset_product(a, b.limit(0)).count() == 0
    assert K.declared_keys(spark, {"p": ["u", "v"], "q": [1, 2, 3]}).count() == 6
    many = K.keyset_product(a, spark.range(9001))
    assert many.count() == 18002 and many.distinct().count() == 18002
    assert K.declared_keys(spark, {"p": list(range(6000)), "q": ["u", "v"]}).distinct().count() == 12000
    assert K.public_multiplicity(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"]) == 2
    assert K.public_multiplicity(a.limit(0), ["a"]) == 0


def test_materialise_is_computed_once(spark):
    df = spark.range(100).select(F.rand().alias("x"), F.uuid().alias("u"))
    kept = M.materialise(df)
    assert kept.schema == df.schema or kept.dtypes == df.dtypes
    assert sorted(kept.collect()) == sorted(kept.collect())
    assert M.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("skew", G.SKEWS)
@pytest.mark.parametrize("algorithm", ["md5", "xxhash64"])
def test_skew_normal(spark, skew, algorithm):
    n, scale = 40_000, 250
    df = G.skew_normal_table(spark, n, scale, skew, 1, algorithm)
    assert df.columns == ["values"] and df.count() == n
    row = df.agg(F.avg("values"), F.stddev_samp("values")).first()
    d = skew / math.sqrt(1 + skew * skew)
    mean = scale * d * math.sqrt(2 / math.pi)
    deviation = scale * math.sqrt(1 - 2 * d * d / math.pi)
    assert row[0] == pytest.approx(mean, abs=5 * deviation / math.sqrt(n))
    assert row[1] == pytest.approx(deviation, rel=0.03)


def test_generated_datasets_round_trip(spark, tmp_path):
    made = G.skew_normal_datasets(spark, 50, 7)
    T.write_dataset_dir(made, str(tmp_path / "out"))
    read = T.read_dataset_dir(spark, str(tmp_path / "out"), "values double")
    assert read.groupBy("dataset").count().filter("count = 50").count() == 9
    assert sorted(read.select("dataset", "values").collect()) == sorted(made.select("dataset", "values").collect())


def test_demographics(spark):
    df = G.demographics_table(spark, 30_000, 2)
    row = df.agg(F.min("age"), F.max("age"), F.min("height"), F.max("height"), F.min("income"), F.max("income"), F.avg("income")).first()
    assert (row[0], row[1]) == (0, 120)
    assert 50 <= row[2] < 50.1 and 199.9 < row[3] <= 200
    assert 3000 <= row[4] and row[5] <= 15000
    # mean of a normal(0, 5000) limited to [0.6, 3] deviations
    phi = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    share = 0.5 * (math.erf(3 / math.sqrt(2)) - math.erf(0.6 / math.sqrt(2)))
    assert row[6] == pytest.approx(5000 * (phi(0.6) - phi(3.0)) / share, rel=0.01)


@pytest.fixture(scope="module")
def trials(spark):
    df = spark.range(2000).select(
        F.concat(F.lit("data_"), F.col("id") % 2 * 9 + 1, F.lit("_50_0.csv")).alias("dataset"),
        (F.col("id") % 50 + 0.5).alias("v"),
    )
    epsilons = [0.1, 1.0, 10.0]
    return E.run_trials(df, "dataset", "v", 0, 60, SeededNoise(9), epsilons=epsilons, iterations=200).cache()


def test_trials_are_complete_and_improve_with_epsilon(trials):
    assert trials.count() == 2 * len(E.TRIALS) * 3 * 200
    rows = E.summarise_trials(trials).collect()
    error = {(r["dataset"], r["query"], r["mechanism"], r["epsilon"]): r["mean_error"] for r in rows}
    for (dataset, query, mechanism, epsilon), value in error.items():
        if epsilon == 0.1:
            assert value > error[dataset, query, mechanism, 10.0]
    # mean size of Laplace noise is its scale
    for epsilon in (0.1, 1.0, 10.0):
        got = error["data_1_50_0.csv", "COUNT", "laplace", epsilon]
        assert abs(got * epsilon - 1) < 5 / math.sqrt(200)
        got = error["data_1_50_0.csv", "SUM", "laplace", epsilon]
        assert abs(got * epsilon / 60 - 1) < 5 / math.sqrt(200)


def test_summary_digits(trials):
    rounded = E.summarise_trials(trials, digits=2).first()
    assert rounded["mean_error"] == round(rounded["mean_error"], 2)


def test_results_resume(spark, trials, tmp_path):
    path = str(tmp_path / "results")
    features = T.dataset_features()
    summary = E.summarise_trials(trials).withColumns(features)
    done = summary.filter("epsilon < 1")
    R.append_results(done, path)
    stored = R.read_results(spark, path, summary.schema)
    left = R.pending_trials(summary.select(*E.TRIAL_KEY), stored, E.TRIAL_KEY)
    assert left.count() == summary.filter("epsilon >= 1").count()
    R.append_results(summary.filter("epsilon >= 1"), path)
    again = R.read_results(spark, path, summary.schema)
    assert R.pending_trials(summary.select(*E.TRIAL_KEY), again, E.TRIAL_KEY).isEmpty()
    compared = E.compare_mechanisms(again)
    assert compared.count() == 12
    best = {(r["query"], r["epsilon"]): r["best"] for r in compared.collect()}
    assert best["MEAN", 0.1] in ("public_size", "noisy_size")
    by_size = E.error_by_feature(again, ["dataset_size"]).collect()
    assert {r["dataset_size"] for r in by_size} == {1, 10}


def test_data_bounds(spark):
    assert E.unsafe_data_bounds(spark.range(5), "id") == (0.0, 4.0)


def test_epsilons():
    assert len(E.EPSILONS) == 28 and E.EPSILONS == sorted(E.EPSILONS)
