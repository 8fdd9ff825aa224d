"""Language of a text by bit-sliced Bloom filters over letter n-grams.

One table of masks holds a Bloom filter per language: bit l of position p says that p is set in the
filter of language l. Looking up an n-gram's positions and joining their masks with AND returns all
languages that contain it at once. A text's count per language is corrected for the filter's rate
of false positives, and the language with the most n-grams left is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import blocks, importable, share_of

UNKNOWN = "und"
#: Documents of each language that are read to learn it, about.
SAMPLE = 4096
#: An n-gram belongs to a language where it is this often as frequent as in the language where it is most frequent.
RATIO = 0.25
#: Positions that an n-gram sets, and positions per n-gram and language.
HASHES, ROOM = 3, 16
#: Documents with a smaller share of n-grams in their language are rejected.
LEAST_SHARE = 0.35

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_codes(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (index of the text, n-gram): three letters, or letters with a word's end as zero.

    Texts are lower-cased, and everything that is not a letter ends a word. Each letter is the middle
    of one n-gram, of three code points in 21 bits each.
    """
    for owners, parts in blocks(texts):
        parts = [part.lower() for part in parts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        points = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        at = np.flatnonzero(keep)
        kept = np.zeros(len(at) + 2, np.uint64)
        kept[1:-1] = np.where(letter[at], points[at], 0)
        middle = np.flatnonzero(kept)
        code = kept[middle - 1] << np.uint64(42) | kept[middle] << np.uint64(21) | kept[middle + 1]
        yield np.repeat(np.array(owners, np.int64), sizes)[at[middle - 1]], code


def positions(code: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """The filter positions of each n-gram; `slots` is a power of two."""
    mixed = code * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    step = (mixed >> np.uint64(20)) | np.uint64(1)
    for turn in range(HASHES):
        yield ((mixed + np.uint64(turn) * step) & np.uint64(slots - 1)).astype(np.int64)


@dataclass
class LanguageModel:
    """masks[p, w]: which of the languages 8 w to 8 w + 7 have position p set."""

    languages: list[str]
    masks: np.ndarray

    def false_rates(self) -> np.ndarray:
        """How likely an n-gram outside of a language is found in its filter."""
        bits = np.unpackbits(self.masks, axis=1, bitorder="little")[:, : len(self.languages)]
        return bits.mean(axis=0) ** HASHES

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its n-grams per language, as found, and all its n-grams."""
        slots, words = self.masks.shape
        found = np.zeros((len(texts), 8 * words), np.int64)
        total = np.zeros(len(texts), np.int64)
        bit_table = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
        for owner, code in gram_codes(texts):
            if not len(owner):
                continue
            low = int(owner[0])
            owner = owner - low
            size = int(owner[-1]) + 1
            total[low : low + size] += np.bincount(owner, minlength=size)
            places = list(positions(code, slots))
            for word in range(words):
                column = self.masks[:, word]
                mask = column[places[0]]
                for place in places[1:]:
                    mask = mask & column[place]
                counts = np.bincount(owner * 256 + mask, minlength=size * 256).reshape(size, 256)
                found[low : low + size, 8 * word : 8 * word + 8] += counts @ bit_table
        return found[:, : len(self.languages)], total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and the share of its n-grams that belong to it.

        `und` and 0 for a text without a letter, or if no language was learned. Of equal shares the
        language first in order of names.
        """
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found, total = self.hits(texts)
        false = self.false_rates()
        share = (found - false * total[:, None]) / np.maximum(1 - false, 1e-9) / np.maximum(total, 1)[:, None]
        best = share.argmax(axis=1)
        score = np.clip(share[np.arange(len(texts)), best], 0, 1)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, total)], np.where(total > 0, score, 0.0)


def learn_languages(
    docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    sample: int = SAMPLE, ratio: float = RATIO,
) -> LanguageModel:
    """Fit the filters on about `sample` documents of each language for which `train` holds.

    The sample is by hash of the id. Rows without a language or text teach nothing. Only counts per
    language and the filter itself, whose size is bounded by the sample, reach the driver.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.filter(train).filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return LanguageModel([], np.zeros((1, 1), np.uint8))
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample / r["count"]))])
    rows = rows.filter(share_of(F.coalesce(F.col("id").cast("string"), F.lit("")), shares[F.col("lang")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for name in sorted(set(names)):
                texts = batch.column(1).filter(pa.array(names == name)).to_pylist()
                for _, code in gram_codes(texts):
                    grams, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)],
                        ["lang", "gram", "n"],
                    )

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("all")), "lang")
    rate = F.col("n") / F.col("all")
    most = F.max(rate).over(Window.partitionBy("gram"))
    members = counts.withColumn("most", most).filter((F.col("n") > 1) & (rate >= ratio * F.col("most")))
    members = members.select("lang", "gram")

    languages = [r["lang"] for r in sizes]
    largest = members.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    slots = 1 << max(10, (ROOM * largest - 1).bit_length())
    index = {name: i for i, name in enumerate(languages)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([index[name] for name in batch.column(0).to_pylist()], np.int64)
            code = batch.column(1).to_numpy().view(np.uint64)
            for position in positions(code, slots):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(position), pa.array(which // 8), pa.array(1 << (which % 8))], ["slot", "word", "mask"]
                )

    placed = members.mapInArrow(place, "slot long, word long, mask long")
    filled = placed.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((slots, (len(languages) + 7) // 8), np.uint8)
    masks[filled["slot"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy()
    return LanguageModel(languages, masks)


def language_of(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """struct(lang_pred, score) of each row's whole text."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, score = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": score})

    return predict(F.col(text).cast("string"))


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row; repeated rows each for itself, other columns are not read."""
    found = docs.select(F.col(doc_id), language_of(docs, model, text).alias("found"))
    return found.select(doc_id, "found.lang_pred", "found.score")


def drop_unknown(
    docs: DataFrame, model: LanguageModel, text: str = "text", least: float = LEAST_SHARE
) -> DataFrame:
    """The rows, with all columns, whose text has letters and at least this share of n-grams of one language.

    Without any learned language every text with a letter stays.
    """
    if not model.languages:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    found = language_of(docs, model, text)
    return docs.filter((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
