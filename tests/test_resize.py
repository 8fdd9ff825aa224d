from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hushframe.functions.noise import SeededNoise
from hushframe.functions.uniform import hash52
from hushframe.operators import resize as R


def first(rows, n, columns):
    ordered = sorted(rows, key=lambda r: (r["h"], *[r[c] for c in columns]))
    return sorted(tuple(r[c] for c in columns) for r in ordered[:n])


@pytest.fixture(params=[16, 3], ids=["wide levels", "narrow levels"])
def levels(request, monkeypatch):
    monkeypatch.setattr(R, "LEVEL_BITS", request.param)


@pytest.mark.parametrize("n", [1, 2, 499, 500, 777, 1999, 2000])
def test_sample_of_distinct_rows(spark, levels, n):
    df = spark.range(2000).select("id", (F.col("id") % 7).alias("v"))
    sample = R.hash_sample(df, n, 3)
    rows = df.withColumn("h", hash52(3, "id", "v")).collect()
    assert sorted(tuple(r) for r in sample.collect()) == first(rows, n, ["id", "v"])


@pytest.mark.parametrize("n", [1, 700, 999, 1500, 2000])
def test_sample_cuts_a_group_of_copies(spark, levels, n):
    """A third of the rows are copies of one row, the others of eleven."""
    value = F.when(F.col("id") % 3 == 0, 99).otherwise(F.col("id") % 11)
    df = spark.range(2000).select(value.alias("v"), F.lit("x").alias("t"))
    sample = R.hash_sample(df, n, 3)
    assert sample.count() == n
    rows = df.withColumn("h", hash52(3, "v", "t")).collect()
    assert sorted(tuple(r) for r in sample.collect()) == first(rows, n, ["v", "t"])


def test_longer_than_the_table(spark):
    df = spark.range(10).select((F.col("id") * 1.0).alias("v"))
    assert R.hash_sample(df, 50).count() == 10
    assert R.hash_sample(df.limit(0), 5).count() == 0
    padded = R.resize(df, "v", 50, 2.5, 1.0, 8.0).collect()
    assert len(padded) == 50
    assert sorted(r["v"] for r in padded) == sorted([1, 1, 2, 3, 4, 5, 6, 7, 8, 8] + [2.5] * 40)


def test_sized_statistics_equal_the_resized_table(spark):
    df = spark.range(400).select("id", (F.col("id") % 90 / 1.0).alias("v"))
    quiet = SeededNoise(1)
    for n in (150, 400, 1000):
        v = [r["v"] for r in R.resize(df, "v", n, 10.0, 5.0, 60.0).collect()]
        mean = sum(v) / n
        variance = sum((x - mean) ** 2 for x in v) / (n - 1)
        epsilon = 1e9
        options = {"constant": 10.0}
        assert R.dp_mean_sized(df, "v", 5, 60, n, epsilon, quiet, **options).first()[0] == pytest.approx(mean, abs=1e-6)
        assert R.dp_sum_sized(df, "v", 5, 60, n, epsilon, quiet, **options).first()[0] == pytest.approx(sum(v), abs=1e-4)
        answer = R.dp_variance_sized(df, "v", 5, 60, n, epsilon, quiet, ddof=1, **options).first()[0]
        assert answer == pytest.approx(variance, abs=1e-4)


@pytest.mark.parametrize("n", [2, 3, 5, 8])
def test_variance_sensitivity(n):
    """Largest change of one row in [0, 1], over all tables of end points."""
    def variance(x, ddof):
        mean = sum(x) / len(x)
        return sum((v - mean) ** 2 for v in x) / (len(x) - ddof)

    for ddof in (0, 1):
        most = 0.0
        for ones in range(n):
            rest = [1.0] * ones + [0.0] * (n - 1 - ones)
            most = max(most, abs(variance([0.0, *rest], ddof) - variance([1.0, *rest], ddof)))
        assert most <= R.variance_sensitivity(0, 1, n, ddof) + 1e-12
        assert most == pytest.approx(R.variance_sensitivity(0, 1, n, ddof))


def test_refused():
    quiet = SeededNoise(1)
    with pytest.raises(ValueError):
        R.resize(None, "v", 5, 0.0, 1.0, 2.0)
    with pytest.raises(ValueError):
        R.hash_sample(None, 0)
    with pytest.raises(ValueError):
        R.dp_variance_sized(None, "v", 0, 1, 1, 1.0, quiet)
