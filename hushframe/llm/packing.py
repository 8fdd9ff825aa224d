"""Packing tokenised documents into sequences by the sum-of-squares rule.

Every document becomes token ids and an end id; only longer ones are cut into pieces of a whole
sequence. Pieces are dealt by their place to shards of a bounded number of pieces, whatever the input,
and each shard is packed on its own: pieces in falling order of length, each into the open sequence
for which the sum of the squared counts of open sequences per residual gap becomes smallest. A
sequence is opened when a piece fits in none. Lengths are small whole numbers, so a count per gap
says all there is to know about the open sequences.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import dealt_evenly, importable, unused
from hushframe.plans.materialise import materialise

CONTEXT = 2048
#: Pieces that one task packs.
SHARD = 16384
#: Tasks that shards are dealt to one to one; more shards than that take turns.
TASKS = 1 << 15
#: Words whose ids a worker remembers.
REMEMBERED = 1 << 19

#: Outside of these characters, words are not cut apart here but by the tokenizer, in the whole text. Within
#: them lower case, white space and normal form need no neighbouring character, so words can be encoded alone.
UNUSUAL = re.compile(r"[^\t-\r -~¡-±´-¸º»¿-ɏ]")
#: How the vocabulary's special tokens begin, which may stand in a text.
SPECIAL = "<|"
#: The vocabulary's words (fixed values of the file's format), for the characters above.
WORD = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
#: New words that are encoded in one call.
TOGETHER = 500


class WordIds:
    """Ids of whole texts, encoding each distinct word once.

    The vocabulary never merges over the end of a word, so a text's ids are those of its words.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for word, number in vocabulary.items() if word.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        """Encode words side by side; an id that ends a word tells where the next word's ids begin."""
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) != len(part):
                for word, found in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                    self.known[word] = array("I", found.ids).tobytes()
                continue
            data = ids.tobytes()
            for word, start, stop in zip(part, [0, *stops], stops):
                self.known[word] = data[start:stop]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split = [None if SPECIAL in text or UNUSUAL.search(text) else WORD.findall(text.lower()) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(list(set().union(*(words for words in split if words)).difference(self.known)))
        known = self.known
        out = []
        for text, words in zip(texts, split):
            if words is None:
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join([known[word] for word in words]))
        return out


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker, so that what it remembers outlives a task."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def token_pieces(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", context: int = CONTEXT, end: int = 0
) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian 32-bit numbers) of each piece.

    A document's ids are followed by the end id; null and empty texts have that id only. Every piece
    but a document's last has `context` ids.
    """
    importable(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids"]
    tail = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for whole in batches:
            for low, high in slices(whole.column(1)):
                batch = whole.slice(low, high - low)
                owners, pieces, ids = [], [], []
                for row, found in enumerate(encode(batch.column(1).to_pylist())):
                    found += tail
                    for piece, at in enumerate(range(0, len(found), 4 * context)):
                        owners.append(row)
                        pieces.append(piece)
                        ids.append(found[at : at + 4 * context])
                number = np.array(pieces, np.int32)
                columns = [
                    batch.column(0).take(pa.array(owners, pa.int64())),
                    pa.array(number),
                    pa.array(number.astype(np.int64) * context),
                    pa.array(np.fromiter(map(len, ids), np.int64, len(ids)) // 4),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    cut = narrow.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary")
    return cut.withColumnRenamed("id", doc_id)


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text, one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield low, high
        low = high


def sum_of_squares(lengths: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the place in it of each length, in the order given; sequences count from 0.

    Moving a sequence from gap g to gap g - s changes the sum of squared counts by
    2 (count[g - s] - count[g]) + 2, or by 1 - 2 count[s] when the piece fills it.
    """
    count = np.zeros(context + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(context + 1)]
    sequences = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    total = 0
    for i, s in enumerate(lengths.tolist()):
        change = 2 * (count[: context + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = np.iinfo(np.int64).max
        rest = int(change.argmin())
        gap = rest + s
        if count[gap]:
            count[gap] -= 1
            sequence = opened[gap].pop()
        else:
            rest, gap, sequence = context - s, context, total
            total += 1
        sequences[i] = sequence
        offsets[i] = context - gap
        if rest:
            count[rest] += 1
            opened[rest].append(sequence)
    return sequences, offsets


def pack(
    pieces: DataFrame, doc_id: str = "doc_id", context: int = CONTEXT, shard: int = SHARD
) -> DataFrame:
    """`pieces` (doc_id, piece, length and any more columns) with sequence_id and offset.

    Pieces lie gapless from 0 in each sequence of at most `context` ids. Pieces of a whole sequence
    take one of their own. Equal lengths are ordered by id, then piece; repeated rows are packed each
    for itself, null ids too. No pieces: no rows.
    """
    importable(pieces.sparkSession)
    pieces = materialise(pieces, "pieces")
    total = pieces.count()
    shards = max(1, -(-total // shard))
    key = unused(pieces, "pack_shard")
    dealt = pieces.withColumn(key, dealt_evenly(shards))
    tasks = min(shards, TASKS)
    dealt = dealt.repartitionById(tasks, F.col(key)).sortWithinPartitions(key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", doc_id, "piece"], ascending=[False, True, True], kind="stable")
        at = int(rows[key].iloc[0])
        sequences, offsets = sum_of_squares(rows["length"].to_numpy(np.int64), context)
        return rows.drop(columns=key).assign(sequence_id=sequences * shards + at, offset=offsets)

    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One shard after the other, of which a task has several only if there are more shards than tasks."""
        open_: list[pd.DataFrame] = []
        for batch in batches:
            for at, rows in batch.groupby(key, sort=True):
                if open_ and int(open_[0][key].iloc[0]) != at:
                    yield run(pd.concat(open_))
                    open_ = []
                open_.append(rows)
        if open_:
            yield run(pd.concat(open_))

    return dealt.mapInPandas(run_all, schema + ", sequence_id long, offset long")
