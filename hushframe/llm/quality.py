"""Quality of a text by attention over its passages.

A document is a bag of passages of a fixed number of words, and only the bag has a label. Each
passage is encoded by what its characters and words are like, and one hidden layer. Gated attention,
tanh(V h) times sigmoid(U h), weighs the passages; the weighted mean of their encodings is scored.
All weights are learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import blocks, importable, labelled_sample
from hushframe.plans.materialise import materialise

#: Words of a passage.
PASSAGE = 48
#: Labelled documents that are read to learn from, at most, and passages of all of them together.
SAMPLE, PASSAGES = 6000, 1 << 18
#: Passages, about, whose gradient is computed at once.
CHUNK = 1 << 14
HIDDEN, ATTENTION = 16, 8
THRESHOLD = 0.7

#: Classes of bytes: other, lower case, upper case, digit, white space, stops, quotes and brackets, symbols, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
for _kind, _members in ((4, b" \t\n\x0b\x0c\r"), (5, b".,;:?"), (6, b"\"'()[]{}-"), (7, b"!#$%&*+/<=>@\\^_`|~")):
    _CLASS[list(_members)] = _kind
CLASSES = 9
#: Class shares, then mean word length, words equal to the one before, distinct words, words that end in a symbol,
#: words in capitals, the share of a passage that is filled.
WIDTH = CLASSES + 6
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(255, 0x100000001B3, np.uint64)])


def passages(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (index of the text, features) of each passage. A text without a word has none."""
    for owners, parts in blocks(texts):
        encoded = [part.encode() for part in parts]
        data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        kind = _CLASS[data]
        space = kind == 4
        edge = np.diff(space.astype(np.int8), prepend=1)
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        stop = stop[stop > start[0]] if len(start) else stop[:0]
        if not len(start):
            continue
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        owner = np.repeat(np.array(owners, np.int64), sizes)[start]
        part = np.repeat(np.arange(len(encoded)), sizes)[start]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        number = np.arange(len(start)) - np.repeat(first, np.diff(np.r_[first, len(start)]))
        opens = number % PASSAGE == 0
        passage = np.cumsum(opens) - 1
        count = int(passage[-1]) + 1
        begin = start[opens]

        length = stop - start
        within = np.arange(len(data)) - np.repeat(start, np.diff(np.r_[start, len(data)])) if start[0] == 0 else None
        if within is None:
            within = np.arange(len(data)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(data)]))
        value = np.where(space, 0, data.astype(np.uint64) + np.uint64(1)) * _POWERS[within & 255]
        digest = np.add.reduceat(value, start)

        of_byte = np.repeat(np.arange(count), np.diff(np.r_[begin, len(data)]))
        shares = np.bincount(of_byte * CLASSES + kind[begin[0] :], minlength=count * CLASSES).reshape(count, CLASSES)
        shares = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1)
        words = np.bincount(passage, minlength=count)
        same = np.r_[False, (digest[1:] == digest[:-1]) & (passage[1:] == passage[:-1])]
        key = np.sort(digest * np.uint64(0x9E3779B97F4A7C15) // np.uint64(1 << 24) | passage.astype(np.uint64) << np.uint64(40))
        distinct = np.bincount((key[np.diff(key, prepend=key[0] ^ np.uint64(1)) != 0] >> np.uint64(40)).astype(np.int64), minlength=count)
        ends = kind[stop - 1] == 7
        upper = kind[start] == 2
        upper &= kind[np.minimum(start + 1, stop - 1)] == 2

        def mean(of: np.ndarray) -> np.ndarray:
            return np.bincount(passage, weights=of.astype(float), minlength=count) / words

        rest = [mean(length) / 10, mean(same), distinct / words, mean(ends), mean(upper), words / PASSAGE]
        yield owner[opens], np.concatenate([shares, np.stack(rest, axis=1)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class QualityModel:
    """Standardisation of features, and weights by name."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, features: np.ndarray) -> np.ndarray:
        return np.tanh((features - self.mean) / self.deviation @ self.weights["W"] + self.weights["w"])

    def attention(self, hidden: np.ndarray) -> np.ndarray:
        """Logits of the attention weights."""
        gate = np.tanh(hidden @ self.weights["V"]) * _sigmoid(hidden @ self.weights["U"])
        return gate @ self.weights["a"]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text, over all of its passages; a text without words has one blank passage."""
        top = np.full(len(texts), -np.inf)
        weight = np.zeros(len(texts))
        pooled = np.zeros((len(texts), HIDDEN))

        def add(owner: np.ndarray, features: np.ndarray) -> None:
            """Running softmax: earlier sums are scaled down when a larger logit comes."""
            hidden = self.encode(features)
            logit = self.attention(hidden)
            most = top.copy()
            np.maximum.at(most, owner, logit)
            met = np.unique(owner)
            scale = np.exp(top[met] - most[met])
            weight[met] *= scale
            pooled[met] *= scale[:, None]
            top[met] = most[met]
            share = np.exp(logit - top[owner])
            np.add.at(weight, owner, share)
            np.add.at(pooled, owner, share[:, None] * hidden)

        for owner, features in passages(texts):
            add(owner, features)
        blank = np.flatnonzero(weight == 0)
        if len(blank):
            add(blank, np.zeros((len(blank), WIDTH)))
        return _sigmoid(pooled / weight[:, None] @ self.weights["c"] + self.weights["b"])


def _slope(
    w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, bag: np.ndarray, y: np.ndarray, total: int
) -> dict[str, np.ndarray]:
    """What some whole bags add to the gradient of the mean log loss of `total` bags."""
    h = np.tanh(x @ w["W"] + w["w"])
    t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (t * s) @ w["a"]
    share = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
    share /= np.add.reduceat(share, first)[bag]
    z = np.add.reduceat(share[:, None] * h, first)
    error = (_sigmoid(z @ w["c"] + w["b"]) - y) / total
    dz = (error[:, None] * w["c"])[bag]
    dh = share[:, None] * dz
    dot = (h * dz).sum(axis=1)
    dlogit = share * (dot - np.add.reduceat(share * dot, first)[bag])
    dgate = dlogit[:, None] * w["a"]
    dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
    dh += dt @ w["V"].T + ds @ w["U"].T
    du = dh * (1 - h * h)
    return {
        "W": x.T @ du, "w": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds,
        "a": dlogit @ (t * s), "c": z.T @ error, "b": error.sum(),
    }


def fit(
    features: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.02, seed: int = 7
) -> QualityModel:
    """Adam on the log loss of whole bags; features lists all bags' passages, sizes says how many each bag has."""
    mean = features.mean(axis=0) if len(features) else np.zeros(WIDTH)
    deviation = np.maximum(features.std(axis=0), 0.02) if len(features) else np.ones(WIDTH)
    draw = np.random.default_rng(seed)
    w = {
        "W": draw.normal(0, 0.3, (WIDTH, HIDDEN)), "w": np.zeros(HIDDEN),
        "V": draw.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": draw.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "a": draw.normal(0, 0.3, ATTENTION), "c": draw.normal(0, 0.3, HIDDEN), "b": np.zeros(()),
    }
    share = y.mean() if len(y) else 0.5
    w["b"] = np.array(np.log((share + 0.01) / (1.01 - share)))
    model = QualityModel(mean, deviation, w)
    if not 0 < y.sum() < len(y):
        w["c"] = np.zeros(HIDDEN)
        return model
    chunk = (np.cumsum(sizes) - 1) // CHUNK  # whole bags
    starts = np.flatnonzero(np.diff(chunk, prepend=-1))
    edges = np.r_[0, np.cumsum(sizes)]
    parts = []
    for low, high in zip(starts, np.r_[starts[1:], len(sizes)]):
        x = (features[edges[low] : edges[high]] - mean) / deviation
        parts.append((x, edges[low:high] - edges[low], np.repeat(np.arange(high - low), sizes[low:high]), y[low:high]))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    for step in range(1, steps + 1):
        slope = {k: np.zeros_like(v) for k, v in w.items()}
        for part in parts:
            for k, g in _slope(w, *part, len(y)).items():
                slope[k] = slope[k] + g
        for k in w:
            g = slope[k] + 1e-4 * w[k] * (k not in "wb")
            moment[k][0] = 0.9 * moment[k][0] + 0.1 * g
            moment[k][1] = 0.999 * moment[k][1] + 0.001 * g * g
            w[k] = w[k] - rate * (moment[k][0] / (1 - 0.9**step)) / (np.sqrt(moment[k][1] / (1 - 0.999**step)) + 1e-8)
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: int = PASSAGES) -> QualityModel:
    """Fit on all passages of a bounded sample of labelled documents.

    Whole documents leave the sample, by the hash of their text, until it has at most `limit` passages;
    one stays in any case. Held-out rows and rows without label teach nothing; of several labels the
    largest counts. Without labels of both kinds every document scores the share of ones, or one half.
    Scoring reads all passages of all documents.
    """
    importable(docs.sparkSession)
    known = labelled_sample(docs, labels, "quality", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = [f for _, f in passages([batch.column(3)[row].as_py()])]
                features = np.concatenate(found) if found else np.zeros((1, WIDTH))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, 1) for i in range(3)), pa.array([len(features)], pa.int64()),
                     pa.array([features.astype("<f8").tobytes()], pa.binary())],
                    ["id", "mark", "label", "size", "features"],
                )

    kind = known.schema["id"].dataType.simpleString()
    rows = materialise(
        known.select("id", "mark", "label", "text").mapInArrow(
            run, f"id {kind}, mark long, label double, size long, features binary"
        ),
        "quality-passages",
    )
    sizes = rows.select("mark", "id", "size").toPandas().sort_values(["mark", "id"])
    fits = int((sizes["size"].cumsum() <= limit).sum())
    if fits < len(sizes):
        mark, own = (sizes[c].tolist()[max(fits, 1) - 1] for c in ("mark", "id"))
        rows = rows.filter((F.col("mark") < mark) | (F.col("mark") == mark) & (F.col("id") <= own))
    rows = rows.toPandas().sort_values(["id", "mark"])  # sums in the same order on every run
    features = np.frombuffer(b"".join(rows["features"]), "<f8").reshape(-1, WIDTH)
    return fit(features, rows["size"].to_numpy(np.int64), (rows["label"].to_numpy(float) > 0).astype(float))


def quality_of(docs: DataFrame, model: QualityModel, text: str = "text") -> Column:
    """Score of each row's whole text."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()), dtype=float)

    return run(F.col(text).cast("string"))


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row; repeated rows each for itself, other columns are not read."""
    return docs.select(F.col(doc_id), quality_of(docs, model, text).alias("score"))
