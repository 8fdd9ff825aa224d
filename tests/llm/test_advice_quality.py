"""Training reads every passage of the documents in its sample, and the sample's passages are bounded."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import quality
from hushframe.llm.common import held_out

PLAIN = " ".join(f"word{i}" for i in range(quality.PASSAGE))
BAD = "$$ " * quality.PASSAGE


def seen(monkeypatch):
    calls = []

    def fit(features, sizes, y):
        calls.append((features, sizes, y))
        return quality.QualityModel(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), {})

    monkeypatch.setattr(quality, "fit", fit)
    return calls


def test_all_passages_teach(spark, monkeypatch):
    calls = seen(monkeypatch)
    long = " ".join([PLAIN] * 150 + [BAD] + [PLAIN] * 149)
    docs = spark.createDataFrame([(i, long if i == 1 else PLAIN) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") != 1).cast("int").alias("quality"))
    taught = docs.filter(~held_out(F.col("doc_id"))).count()
    quality.learn_quality(docs, labels)
    [(features, sizes, y)] = calls
    assert sorted(sizes) == [1] * (taught - 1) + [300] and sizes[y == 0] == [300]
    assert np.isclose(features[:, 7].max(), 2 / 3, atol=0.05)  # the one bad passage is there
    for limit in (310, 20, 1):
        quality.learn_quality(docs, labels, limit=limit)
        sizes = calls[-1][1]
        assert set(sizes) <= {1, 300} and len(sizes) and (sizes.sum() <= limit or len(sizes) == 1)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 14])
def test_chunks_do_not_change_the_fit(monkeypatch, chunk):
    draw = np.random.default_rng(2)
    sizes = draw.integers(1, 9, 50)
    features = draw.normal(0, 1, (sizes.sum(), quality.WIDTH))
    y = draw.integers(0, 2, 50).astype(float)
    whole = quality.fit(features, sizes, y, steps=5)
    monkeypatch.setattr(quality, "CHUNK", chunk)
    parts = quality.fit(features, sizes, y, steps=5)
    assert all(np.allclose(whole.weights[k], parts.weights[k]) for k in whole.weights)
