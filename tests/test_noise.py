from __future__ import annotations

import math
from fractions import Fraction
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from hushframe.functions import noise as N
from hushframe.functions import secure
from hushframe.functions.uniform import hash52, uniform
from hushframe.sources.generators import inverse_normal

ROWS = 20_000


def within(values, expected, spread):
    """The mean of the values lies within five standard errors."""
    assert abs(sum(values) / len(values) - expected) < 5 * spread / math.sqrt(len(values))


@pytest.mark.parametrize("algorithm", ["md5", "xxhash64"])
def test_uniform_does_not_depend_on_partitions(spark, algorithm):
    u = uniform("s", "id", algorithm=algorithm).alias("u")
    a = spark.range(0, 1000, 1, 4).select("id", u).collect()
    b = spark.range(0, 1000, 1, 5).repartition(3).select("id", u).collect()
    assert sorted(a) == sorted(b)
    assert all(0 < r["u"] < 1 for r in a)
    within([r["u"] for r in a], 0.5, math.sqrt(1 / 12))


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        hash52("s", "id", algorithm="crc")


@pytest.mark.parametrize("algorithm", ["md5", "xxhash64"])
@pytest.mark.parametrize(
    ("mechanism", "scale", "size"),
    [
        ("laplace", 3.0, 3.0),
        ("geometric", 3.0, None),
        ("gaussian", 9.0, 3.0 * math.sqrt(2 / math.pi)),
        ("discrete_gaussian", 9.0, 3.0 * math.sqrt(2 / math.pi)),
    ],
)
def test_seeded_noise(spark, algorithm, mechanism, scale, size):
    source = N.SeededNoise("seed", algorithm)
    noise = source.noise(mechanism, "x", F.lit(scale), ["id"]).alias("x")
    values = [r["x"] for r in spark.range(ROWS).select(noise).collect()]
    if size is None:
        p = math.exp(-1 / scale)
        size = 2 * p / (1 - p * p)
    within(values, 0.0, 2 * scale)
    within([abs(v) for v in values], size, 1.2 * scale)
    if mechanism in ("geometric", "discrete_gaussian"):
        assert all(isinstance(v, int) for v in values)


def test_secure_samplers():
    p = math.exp(-1 / 2.5)
    draws = [secure.discrete_laplace(Fraction(2.5)) for _ in range(ROWS)]
    within(draws, 0.0, 3.6)
    within([abs(x) for x in draws], 2 * p / (1 - p * p), 2.6)
    zero = sum(x == 0 for x in draws) / ROWS
    assert abs(zero - (1 - p) / (1 + p)) < 5 * 0.5 / math.sqrt(ROWS)
    draws = [secure.discrete_gaussian(Fraction(6.25)) for _ in range(ROWS)]
    within(draws, 0.0, 2.5)
    within([x * x for x in draws], 6.25, 6.25 * math.sqrt(2))
    noisy = [secure.noisy_value("laplace", 10.25, 2.0) for _ in range(ROWS)]
    within([abs(x - 10.25) for x in noisy], 2.0, 2.0)


def test_secure_release_is_drawn_once(spark):
    exact = spark.range(50).select("id", F.lit(7).cast("bigint").alias("n"), F.lit(1.5).alias("x"))
    draws = [N.Draw("n", "geometric", 5.0), N.Draw("x", "laplace", 5.0)]
    release = N.SecureNoise().add(exact, draws, ["id"])
    assert release.columns == ["id", "n", "x"]
    assert dict(release.dtypes) == {"id": "bigint", "n": "bigint", "x": "double"}
    assert sorted(release.collect()) == sorted(release.collect())
    other = N.SecureNoise().add(exact, draws, ["id"])
    assert sorted(release.collect()) != sorted(other.collect())


def test_grid_noise_stays_on_the_grid(spark):
    exact = spark.range(20).select("id", F.lit(1234).cast("decimal(38,0)").alias("s"))
    for source in (N.SeededNoise(1), N.SecureNoise()):
        rows = source.add(exact, [N.Draw("s", "geometric", 40.0, 0.25)], ["id"]).collect()
        assert all((r["s"] / 0.25).is_integer() for r in rows)


def test_rejected_noise():
    with pytest.raises(ValueError):
        N.Draw("x", "uniform", 1.0)
    with pytest.raises(ValueError):
        N.Draw("x", "laplace", 0.0)


def test_inverse_normal(spark):
    points = [1e-9, 1e-4, 0.01, 0.02425, 0.2, 0.5, 0.7, 0.99, 0.9999]
    df = spark.createDataFrame([(p,) for p in points], "p double").withColumn("z", inverse_normal(F.col("p")))
    for row in df.collect():
        assert row["z"] == pytest.approx(NormalDist().inv_cdf(row["p"]), rel=1e-8, abs=1e-8)


def test_missing_and_separated_keys_have_noise_of_their_own(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), (None, None), ("a|", "b"), ("a", "|b"), ("a\\", "b")], "a string, b string")
    for algorithm in ("xxhash64", "md5"):
        assert df.select(hash52(1, "a", "b", algorithm=algorithm).alias("h")).distinct().count() == 6
