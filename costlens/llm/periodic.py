"""Periodic runs of words, by block convolution.

A run is a stretch of words with smallest period q, at least ``LEAST_LENGTH`` and 2q
words long, that no neighbouring word extends.  A scale of block length B looks for
the periods 2B to 4B - 1 (the first scale for 1 to 7): any such run holds a whole
aligned block whose copy, one period on, lies in the run too.  The sum of squared
differences of a block and each place of the window that follows is a convolution,
done exactly by a number-theoretic transform modulo ``PRIME``; where it is zero the
block occurs.  Neighbouring blocks with the same distance are one seed, compared word
by word and extended both ways; a stretch that a shorter period explains is dropped.

A block takes part in a scale only if each of its words occurs again within 4B words,
and unless it lies deep in a run of period B or less: the others can't yield a new run
of that scale, so nothing is lost.  Memory is bounded by a portion of texts (or one longer text)
and by ``POINTS`` transform points.  There is no shuffle; a lost task is run again.

Defined results: null, empty and blank texts have no words and no runs; texts of any
length are searched whole; of several longest runs the report names the first, then
the one of the smallest period; repeated rows get equal results; an empty table gives
no rows; only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import portions

LEAST_LENGTH = 12
#: 15 * 2**27 + 1; 31 generates its multiplicative group.
PRIME, GENERATOR = 2013265921, 31
P = np.uint64(PRIME)
#: Points that are transformed at once (8 MB an array); one larger block goes alone.
POINTS = 2**20


@lru_cache(64)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers of the root of unity that joins two halves of a transform."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    step = pow(root, PRIME - 2, PRIME) if inverse else root
    powers = np.ones(half, np.uint64)
    done = 1
    while done < half:
        powers[done : 2 * done] = powers[:done] * np.uint64(pow(step, done, PRIME)) % P
        done *= 2
    return powers


def _transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    m, size = rows.shape
    half = size // 2
    while half:
        pairs = rows.reshape(m, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        out[:, :, 0] = (a + b) % P
        out[:, :, 1] = (a + P - b) % P * _roots(half, False) % P
        rows, half = out.reshape(m, size), half // 2
    return rows


def _back(rows: np.ndarray) -> np.ndarray:
    """Undoes ``_transform``."""
    m, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(m, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1] * _roots(half, True) % P
        out = np.empty_like(pairs)
        out[:, :, 0] = (a + b) % P
        out[:, :, 1] = (a + P - b) % P
        rows, half = out.reshape(m, size), half * 2
    return rows * np.uint64(pow(size, PRIME - 2, PRIME)) % P


def _occurrences(x: np.ndarray, blocks: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (by number) and distances of ``low`` to ``high - 1`` at which they occur again.

    ``x`` has a value of its own behind its end, ``high + size`` times.  As sums are
    taken modulo ``PRIME``, a pair may be wrong; none is missed.
    """
    points, lags = 4 * size, high - low
    # squares below the prime, so sums of 2**32 of them fit
    squares = np.concatenate([[0], np.cumsum(x * x % P)])
    found_block, found_lag = [], []
    for i in range(0, len(blocks), max(1, POINTS // points)):
        some = blocks[i : i + max(1, POINTS // points)]
        start = some[:, None] * size
        block = np.zeros((len(some), points), np.uint64)
        block[:, -np.arange(size)] = x[start + np.arange(size)]
        window = np.zeros((len(some), points), np.uint64)
        reach = lags + size - 1
        window[:, :reach] = x[start + low + np.arange(reach)]
        products = _back(_transform(block) * _transform(window) % P)[:, :lags]
        places = start + low + np.arange(lags)
        own = (squares[start + size] - squares[start]) % P
        other = (squares[places + size] - squares[places]) % P
        differ = (own + other + 2 * (P - products)) % P
        at, lag = np.nonzero(differ == 0)
        found_block.append(some[at])
        found_lag.append(lag + low)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_block]), np.concatenate([none, *found_lag])


def _reach(x: np.ndarray, n: int, at: int, distance: int, step: int) -> int:
    """How many words from ``at`` on (in direction ``step``) equal those ``distance`` later."""
    done, size = 0, 16
    while True:
        if step > 0:
            a, b = at + done, min(at + done + size, n - distance)
        else:
            a, b = max(at - done - size + 1, 0), at - done + 1
        if a >= b:
            return done
        same = x[a:b] == x[a + distance : b + distance]
        same = same if step > 0 else same[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, size = done + b - a, min(size * 2, 2**16)


def _primes(n: int) -> list[int]:
    out, k = [], 2
    while k * k <= n:
        if n % k == 0:
            out.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return [*out, n] if n > 1 else out


def _has_shorter(x: np.ndarray, start: int, stop: int, period: int) -> bool:
    """Whether a divisor of the period is one, too."""
    for prime in _primes(period):
        q = period // prime
        if x[start] == x[start + q] and (x[start : stop - q] == x[start + q : stop]).all():
            return True
    return False


def find_runs(ids: np.ndarray, longest: int) -> np.ndarray:
    """Start, length and period of all runs, ordered by start, then period.

    Different texts in ``ids`` share no id; the longest has ``longest`` words.
    """
    n = len(ids)
    gap = np.full(n, n + 1, np.int64)  # to the next occurrence of the same word
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    runs: dict[tuple[int, int], int] = {}
    size = 2
    while longest >= max(LEAST_LENGTH, 4 * size if size > 2 else 0):
        low, high = (1, 8) if size == 2 else (2 * size, 4 * size)
        n_blocks = n // size
        possible = gap[: n_blocks * size].reshape(n_blocks, size).max(1) < high
        for (start, period), length in runs.items():
            if period <= size and length >= 6 * size:
                possible[-(-start // size) : (start + length - 5 * size) // size + 1] = False
        blocks = np.flatnonzero(possible)
        if len(blocks):
            # what stands behind the end equals no word
            padded = np.concatenate([ids, np.full(high + size, ids.max() + 1)])
            _extend(padded, n, *_occurrences(padded.astype(np.uint64), blocks, size, low, high), size, runs)
        size *= 2
    found = np.array([(s, length, q) for (s, q), length in runs.items()], np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _extend(x: np.ndarray, n: int, block: np.ndarray, distance: np.ndarray, size: int, runs: dict) -> None:
    """Adds the runs around blocks that occur again at a distance."""
    for (start, period), length in runs.items():
        if length >= size + period:  # multiples of its period say nothing new inside a run
            inside = (block * size >= start) & (block * size + size + distance <= start + length)
            new = ~inside | (distance % period != 0)
            block, distance = block[new], distance[new]
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    first = np.ones(len(block), bool)
    first[1:] = (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + 1)
    at = np.flatnonzero(first)
    ends = np.append(at[1:], len(block))[: len(at)] - 1
    for a, b, d in zip((block[at] * size).tolist(), ((block[ends] + 1) * size).tolist(), distance[at].tolist(), strict=True):
        same = x[a:b] == x[a + d : b + d]
        # pieces of the seed that truly occur again: all of it, but for sums that only vanish modulo the prime
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for left, right in zip((edges[::2] + a).tolist(), (edges[1::2] + a).tolist(), strict=True):
            start = left - _reach(x, n, left - 1, d, -1)
            stop = right + _reach(x, n, right, d, 1) + d
            if stop - start >= max(LEAST_LENGTH, 2 * d) and (start, d) not in runs and not _has_shorter(x, start, stop, d):
                runs[start, d] = stop - start


def _number(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray]:
    """Words of each text, and an id for each word of all of them; no two texts share one."""
    # bytes split at \x20 and \x09 to \x0d, as the words of this library do
    words = [x.encode().split() for x in texts]
    numbers, parts = count(), [np.zeros(0, np.int64)]
    for own in words:
        known = defaultdict(numbers.__next__)
        parts.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
    return words, np.concatenate(parts)


SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(keys: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
    words, ids = _number(texts)
    sizes = np.array([len(x) for x in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    runs = find_runs(ids, int(sizes.max())) if len(ids) else np.zeros((0, 3), np.int64)
    cuts = np.searchsorted(runs[:, 0], np.append(starts, len(ids)))
    collapsed = []
    for i, own in enumerate(words):
        mine = runs[cuts[i] : cuts[i + 1]]
        mine[:, 0] -= starts[i]
        if len(mine):
            edges = np.zeros(len(own) + 1, np.int64)
            np.add.at(edges, mine[:, 0] + mine[:, 2], 1)
            np.add.at(edges, mine[:, 0] + mine[:, 1], -1)
            own = compress(own, (np.cumsum(edges[:-1]) == 0).tolist())
        collapsed.append(b" ".join(own).decode())
    each = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=list(_RUN))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, kind),
            pa.array(sizes),
            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each),
            pa.array(collapsed, pa.string()),
        ],
        ["id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of words, all runs by start and then period, and the text without
    the words that repeat an earlier period of a run, joined by one space."""

    def each(batches):
        for batch in batches:
            for keys, texts in portions([batch]):
                yield _batch(keys, texts, batch.column(0).type)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(each, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def longest(runs):
    """The longest run of an array; of several the first, then that of the smallest period."""
    key = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    best = F.array_min(F.transform(runs, key))
    return F.when(F.size(runs) > 0, F.struct(best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period")))
