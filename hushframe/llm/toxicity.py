"""Toxicity of a text by a weighted finite-state grammar over its clauses.

Words carry classes: insults and threats with a weight, targets, negations and words of saying. A
composed transducer (see transducers.py) reads each clause that holds an insult or threat and adds
up weights, so a clause is scored by what it says, not by its words alone. Insults are learned from
labels: words found in far more toxic documents than others. A logistic curve over the clause
scores of a document, fitted on other labelled documents, gives its score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm import transducers as T
from hushframe.llm.common import importable, labelled_sample
from hushframe.plans.materialise import materialise

#: Labelled documents that are read to learn from, at most.
SAMPLE = 20000
#: Toxic documents a learned word must be in, and how strongly (a log ratio) it must speak for them.
LEAST_DOCS, LEAST_WEIGHT = 3, 2.0
THRESHOLD = 0.3

#: Weight of the words below, where labels don't teach another.
KNOWN_WEIGHT = 3.0
INSULTS = (
    "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown clowns imbecile "
    "idioten dumm dummkopf abschaum trottel wertlos idiota idiotas estúpido estúpida imbécil basura "
    "imbécile crétin ordure minable"
).split()
THREATS = "kill hurt destroy beat stab shoot töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yourself they them he she him her du dich dir euch sie tu toi vous te ti usted ustedes".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says called told wrote claims sagte sagt schrieb dit disait écrit dijo dice escribió".split()

WORD = re.compile(r"\w+(?:'\w+)?")
CLAUSE = re.compile(r"[^.!?;:\n|,]+")


def _classes() -> dict[str, tuple[int, float]]:
    """Class and weight of each fixed word; insults come last, as they count most."""
    known = {}
    for kind, words in ((T.REPORT, REPORTS), (T.NEGATION, NEGATIONS)):
        known.update((word, (kind, 0.0)) for word in words)
    for kind, words in ((T.TARGET, TARGETS), (T.THREAT, THREATS), (T.INSULT, INSULTS)):
        known.update((word, (kind, KNOWN_WEIGHT)) for word in words)  # a target's counts where it completes a threat
    return known


@dataclass
class Grammar:
    """Classes of words and the composed transducer."""

    words: dict[str, tuple[int, float]]
    following: list[list[int]] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.following, self.weights = T.grammar()
        self._search = None

    def __getstate__(self):
        return self.__dict__ | {"_search": None}

    def _automaton(self):
        """Finds insults and threats in one pass over a text."""
        if self._search is None:
            import ahocorasick

            self._search = ahocorasick.Automaton()
            for word, (kind, _) in self.words.items():
                if kind in (T.INSULT, T.THREAT):
                    self._search.add_word(word, len(word))
            self._search.make_automaton()
        return self._search

    def clause(self, text: str) -> float:
        """Weight of one clause, a lower-case text."""
        state, total = 0, 0.0
        for word in WORD.findall(text):
            kind, weight = self.words.get(word, (T.OTHER, 0.0))
            total += self.weights[state][kind] * weight
            state = self.following[state][kind]
        return total

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Weight of all clauses, clauses that have one, and words of a text, about (its white space)."""
        text = (text or "").lower()
        words = float(len(text.split()))
        places = [
            end
            for end, size in self._automaton().iter(text)
            if not (text[end - size : end - size + 1].isalnum() and end >= size) and not text[end + 1 : end + 2].isalnum()
        ]
        total, matched, at = 0.0, 0, 0
        if places:
            for found in CLAUSE.finditer(text):
                if at < len(places) and places[at] < found.end():
                    weight = self.clause(found.group())
                    total += weight
                    matched += weight > 0
                    while at < len(places) and places[at] < found.end():
                        at += 1
        return total, float(matched), words


def inputs(total: np.ndarray, matched: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the logistic curve reads of a document."""
    rate = total / np.maximum(words, 1)
    return np.stack([np.ones_like(total), np.log1p(total), np.log1p(matched), np.log1p(100 * rate)], axis=1)


#: The curve before any label: a matched clause of two known insults is toxic.
PRIOR = np.array([-4.0, 1.0, 1.0, 0.5])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients by Newton's method, drawn towards the prior, so that few labels change little."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    grammar: Grammar
    coefficients: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text; null and empty texts score like any text without a match."""
        found = np.array([self.grammar.features(t) for t in texts], float).reshape(-1, 3)
        at = np.clip(inputs(found[:, 0], found[:, 1], found[:, 2]) @ self.coefficients, -500, 500)
        return 1 / (1 + np.exp(-at))


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn insults from two thirds of a bounded labelled sample and the curve from the rest.

    Held-out rows, rows without label and documents without a label row teach nothing; of several
    labels of a document the largest counts. Copies of a text count once, so that a group of copies
    can't make its words look common. Targets, threats, negations and words of saying keep their class,
    whatever labels say. The lexicon's words with a weight each reach the driver, and three numbers per
    document of the sample.
    """
    spark = docs.sparkSession
    importable(spark)
    known = labelled_sample(docs, labels, "toxic", sample)
    known = known.groupBy(F.lower("text").alias("text")).agg(F.min("id").alias("id"), F.max("label").alias("label"))
    known = materialise(known.withColumn("part", F.crc32(F.col("id").cast("string").cast("binary")) % 4), "toxic-sample")
    first, second = known.filter("part <> 3"), known.filter("part = 3")

    sizes = {r["label"]: r["count"] for r in first.groupBy((F.col("label") > 0).alias("label")).count().collect()}
    grammar = Grammar(_classes())
    if sizes.get(True) and sizes.get(False):
        words = F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}_]+"))).alias("word")
        bad = F.sum((F.col("label") > 0).cast("long"))
        counts = first.select("label", words).filter("length(word) > 1").groupBy("word").agg(
            bad.alias("bad"), F.count(F.lit(1)).alias("n")
        )
        weight = F.log((F.col("bad") + 0.5) / (sizes[True] + 1.0)) - F.log(
            (F.col("n") - F.col("bad") + 0.5) / (sizes[False] + 1.0)
        )
        strong = counts.filter(F.col("bad") >= LEAST_DOCS).withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT)
        for r in strong.select("word", "weight").collect():
            if grammar.words.get(r["word"], (T.INSULT,))[0] == T.INSULT:
                grammar.words[r["word"]] = (T.INSULT, r["weight"])

    found = second.select("id", "label", _features(second, grammar).alias("f")).select("id", "label", "f.*").toPandas()
    found = found.sort_values("id")  # sums in the same order on every run
    y = (found["label"].to_numpy(float) > 0).astype(float)
    x = inputs(*(found[c].to_numpy(float) for c in ("total", "matched", "words")))
    coefficients = fit_logistic(x, y)
    return ToxicityModel(grammar, coefficients)


def _features(docs: DataFrame, grammar: Grammar) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("total double, matched double, words double")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.features(t) for t in texts.tolist()]
        return pd.DataFrame(found, columns=["total", "matched", "words"], dtype=float)

    return run(F.col("text"))


def toxicity_of(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """Score of each row's whole text."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()), dtype=float)

    return run(F.col(text).cast("string"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row; repeated rows each for itself, other columns are not read."""
    return docs.select(F.col(doc_id), toxicity_of(docs, model, text).alias("score"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all columns, that score below the threshold."""
    return docs.filter(toxicity_of(docs, model, text) < threshold)
