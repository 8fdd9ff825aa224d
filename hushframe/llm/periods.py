"""Runs of repeated words, found by block convolution.

A run of period q that is at least four periods long holds, on the scale B = 2^k with B <= q < 2B, a whole
aligned block of B words that occurs again q words later. So on each scale the words are cut into blocks of B, and
each block is matched against the window that follows it: the sum of squared differences at every distance
from B to 2B - 1, computed by exact number-theoretic transforms, is zero where the block recurs. Each
such distance seeds an extension to both sides, word by word, which gives the maximal stretch.

Two things spare work and lose nothing. A block with a word that does not come again within 2B words cannot
recur at these distances, so it is not transformed. And a block that lies with its window inside a run of smaller period
can only recur at multiples of that period (two periods of so long a stretch have their divisor as a period).
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import importable

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Primes of the form c 2^k + 1 with k >= 26, below 2^31, and a generator of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Words that one transform holds at once, over all its rows.
ROOM = 1 << 20
#: Characters of the texts that are searched together.
CHARACTERS = 1 << 21


@functools.cache
def _roots(size: int, prime: int, generator: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Powers of the roots of unity for each step of a transform, their inverses, and 1 / size."""
    forward, backward = [], []
    length = size
    while length > 1:
        root = pow(generator, (prime - 1) // length, prime)
        for table, base in ((forward, root), (backward, pow(root, prime - 2, prime))):
            powers = np.ones(length // 2, np.uint64)
            step, filled = base, 1
            while filled < length // 2:
                powers[filled : 2 * filled] = powers[:filled] * np.uint64(step) % np.uint64(prime)
                step, filled = step * step % prime, 2 * filled
            table.append(powers)
        length //= 2
    return forward, backward, pow(size, prime - 2, prime)


def _forward(rows: np.ndarray, roots: list[np.ndarray], prime: np.uint64) -> np.ndarray:
    """Transform of each row, in bit-reversed order (decimation in frequency)."""
    count, size = rows.shape
    for powers in roots:
        half = len(powers)
        parts = rows.reshape(count, -1, 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1]
        out = np.empty_like(parts)
        out[:, :, 0] = (low + high) % prime
        out[:, :, 1] = (low + prime - high) % prime * powers % prime
        rows = out.reshape(count, size)
    return rows


def _backward(rows: np.ndarray, roots: list[np.ndarray], inverse: int, prime: np.uint64) -> np.ndarray:
    """From bit-reversed order back (decimation in time)."""
    count, size = rows.shape
    for powers in reversed(roots):
        half = len(powers)
        parts = rows.reshape(count, -1, 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1] * powers % prime
        out = np.empty_like(parts)
        out[:, :, 0] = (low + high) % prime
        out[:, :, 1] = (low + prime - high) % prime
        rows = out.reshape(count, size)
    return rows * np.uint64(inverse) % prime


def mismatches(blocks: np.ndarray, windows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Sum over j of (block[j] - window[i + j])^2 modulo a prime, for each row and each i of a whole fit.

    The cross term is a cyclic correlation of at least the window's length, so nothing wraps into the fits.
    """
    p = np.uint64(prime)
    width, reach = blocks.shape[1], windows.shape[1]
    size = 1 << (reach - 1).bit_length() if reach > 1 else 1
    forward, backward, inverse = _roots(size, prime, generator)
    left = np.zeros((len(blocks), size), np.uint64)
    left[:, :width] = blocks[:, ::-1] % prime
    right = np.zeros((len(blocks), size), np.uint64)
    right[:, :reach] = windows % prime
    cross = _backward(_forward(left, forward, p) * _forward(right, forward, p) % p, backward, inverse, p)
    cross = cross[:, width - 1 : reach]
    own = (left * left % p).sum(axis=1, keepdims=True) % p
    upto = np.concatenate([np.zeros((len(blocks), 1), np.uint64), np.cumsum(right[:, :reach] * right[:, :reach] % p, axis=1)], axis=1)
    theirs = (upto[:, width:] - upto[:, :-width]) % p
    return (own + theirs + 2 * (p - cross)) % p


def zero_distances(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all blocks of `width` words that recur at a distance from `width` to `2 width - 1`.

    Blocks at the given starts. Words are small numbers without a sign; behind the end nothing recurs. As many primes are
    taken as the largest possible sum needs, so a sum is zero exactly if all its remainders are.
    """
    found_start, found_distance = [], []
    reach = 2 * width - 1
    top = int(words.max(initial=0)) + 1
    bound, primes, product = width * top * top, [], 1
    for prime, generator in PRIMES:
        if product <= bound:
            primes.append((prime, generator))
            product *= prime
    if product <= bound:
        raise ValueError("too many different words for exact sums")
    padded = np.concatenate([words, np.full(3 * width, top, words.dtype)])
    rows = max(1, ROOM // (4 * width))
    for begin in range(0, len(starts), rows):
        at = starts[begin : begin + rows, None]
        blocks = padded[at + np.arange(width)]
        windows = padded[at + width + np.arange(reach)]
        zero = None
        for prime, generator in primes:
            these = mismatches(blocks, windows, prime, generator) == 0
            zero = these if zero is None else zero & these
        row, shift = np.nonzero(zero)
        found_start.append(at[row, 0])
        found_distance.append(width + shift)
    if not found_start:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_start), np.concatenate(found_distance)


def _agreeing(words: np.ndarray, low: int, high: int, at: int, period: int, step: int) -> int:
    """How many places from `at` on, towards `step`, equal the word a period later; both lie in low..high."""
    count, stretch = 0, 64
    while True:
        room = high - period - at if step > 0 else at - low + 1
        take = min(stretch, room)
        if take <= 0:
            return count
        if step > 0:
            same = words[at : at + take] == words[at + period : at + period + take]
        else:
            same = words[at - take + 1 : at + 1][::-1] == words[at - take + 1 + period : at + 1 + period][::-1]
        wrong = int(np.argmin(same))
        if not same[wrong]:
            return count + wrong
        count, at, stretch = count + take, at + step * take, 2 * stretch


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text all runs as (start, length, period) by start and period.

    `words` are numbers (equal for equal words) of texts that stand one behind the other, text t from
    `bounds[t]` to `bounds[t + 1]`.
    """
    total, texts = len(words), len(bounds) - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
    if not total:
        return runs
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    order = np.lexsort((words, owner)) if texts > 1 else np.argsort(words, kind="stable")
    gap = np.full(total, total + 1, np.int64)
    same = (words[order[1:]] == words[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    gap[order[:-1][same]] = order[1:][same] - order[:-1][same]
    longest = int(np.diff(bounds).max(initial=0))
    width = 1
    known: list[list[tuple[int, int]]] = [[] for _ in range(texts)]
    while LEAST_PERIODS * width <= longest and len(gap):
        block = np.flatnonzero(gap < 2 * width)
        starts = block * width
        ends = starts + width - 1
        starts = starts[owner[starts] == owner[ends]]
        if len(starts):
            starts = _outside(starts, starts + 3 * width - 1, owner, known, bounds)
        if len(starts):
            seeds = zero_distances(words, starts, width)
            _extend(words, *seeds, width, owner, bounds, runs, known)
        gap = np.maximum(gap[: len(gap) // 2 * 2 : 2], gap[1::2])
        width *= 2
    return [sorted(found) for found in runs]


def _outside(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, known, bounds: np.ndarray) -> np.ndarray:
    """The starts of the ranges (cut off at their text's end) that lie in no known run."""
    keep = np.ones(len(starts), bool)
    of = owner[starts]
    ends = np.minimum(ends, bounds[of + 1])
    for text in np.unique(of):
        if known[text]:
            low, high = np.searchsorted(of, [text, text + 1])
            for begin, end in known[text]:
                keep[low:high] &= (starts[low:high] < begin) | (ends[low:high] > end)
    return starts[keep]


def _extend(words, starts, distances, width, owner, bounds, runs, known) -> None:
    """Turn seeds into maximal stretches, and keep those that are long enough.

    Seeds of a stretch that was tried at the same distance, and seeds inside a run of smaller period, are passed over.
    """
    order = np.lexsort((starts, distances, owner[starts]))
    before = [list(k) for k in known]
    tried_text, tried_distance, tried_end = -1, -1, -1
    for start, period in zip(starts[order].tolist(), distances[order].tolist()):
        text = int(owner[start])
        low, high = int(bounds[text]), int(bounds[text + 1])
        reach = start + width + period
        if reach > high:
            continue
        if (text, period) != (tried_text, tried_distance):
            tried_text, tried_distance, tried_end = text, period, -1
        if reach <= tried_end or any(b <= start and reach <= e for b, e in before[text]):
            continue
        first = start - _agreeing(words, low, high, start - 1, period, -1)
        last = start + width + _agreeing(words, low, high, start + width, period, 1) + period
        tried_end = last
        if last - first >= max(LEAST_WORDS, LEAST_PERIODS * period):
            runs[text].append((first - low, last - first, period))
            known[text].append((first, last))


def damaged_order(count: int, doc_id: int | None) -> np.ndarray | None:
    """Which word stands at each place after the damage done to some documents by their id; None: unchanged.

    A row without an id is not damaged.
    """
    if doc_id is None or not count:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    at = g % count
    period = 1 + (count - at) // (3 + g % 8)
    order = np.arange(count)
    order[at:] = at + np.arange(count - at) % period
    return order


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the largest length by period, compared as whole numbers; then smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


OUT = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "collapsed string"
)


def _rows(words: list[list[bytes]]) -> Iterator[tuple]:
    """The columns of `OUT` for each text."""
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    flat = [w for text in words for w in text]
    numbers = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for text, runs in zip(words, find_runs(numbers, bounds)):
        listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = text
        if runs:
            stays = np.ones(len(text), bool)
            for start, length, period in runs:
                stays[start + period : start + length] = False
            kept = [text[i] for i in np.flatnonzero(stays)]
        joined = b" ".join(kept)
        best = _greatest(runs)
        top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        yield (len(runs), *top, listed, hashlib.sha256(joined).hexdigest(), joined.decode())


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damage: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, the columns of `OUT`, and the text with all runs collapsed.

    Words are separated by `[\\x20\\x09-\\x0D]`. A run is a maximal stretch of words of smallest period q with
    at least `LEAST_WORDS` words and `LEAST_PERIODS` periods. Collapsing drops what a run repeats after its first period. Null and
    empty texts have no run and collapse to an empty text. Of runs with equal length by period the first one,
    then the one of smaller period, is the greatest. Repeated rows are treated each; other columns are not read.
    With `damage` some documents, told by their id, are first made periodic from some word on.
    """
    importable(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            schema = schema or pa.schema(
                [("id", ids.type)] + [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in OUT.split(", ")]
            )
            begin = 0
            while begin < len(ids):
                words, end, held = [], begin, 0
                while end < len(ids) and (held == 0 or held < CHARACTERS):
                    body = (texts[end].as_py() or "").encode()
                    split = body.split()
                    order = damaged_order(len(split), ids[end].as_py()) if damage else None
                    words.append(split if order is None else [split[i] for i in order])
                    held += len(body) + 1
                    end += 1
                columns = list(zip(*_rows(words)))
                arrays = [ids.slice(begin, end - begin)] + [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
                begin = end

    return narrow.mapInArrow(run, f"id {kind}, {OUT}").withColumnRenamed("id", doc_id)
