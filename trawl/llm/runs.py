"""Periodic runs of words: maximal stretches that repeat a period at least twice.

A run's period begins, somewhere in the run, a Lyndon word that is the longest
to start at its position, in the order in which the word that breaks the run is
smaller than the word a period before it. So one scan from right to left with a
stack of Lyndon words, under an order of the words and under its reverse, meets
every run; each Lyndon word's period is extended both ways. Suffixes are
compared, and periods extended, by a binary search for the length of a common
extension over rolling hashes; each length that is found is verified word by
word, and a failed one counted word by word, so no result rests on a hash.

Only stretches of windows that occur twice in the text are scanned. A run of at
least ``shortest`` words and two periods lies in one of them: each of its words
is in a window of half as many words that, one period on or back, is in the run
again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import picked, stretches

#: Words in the shortest run.
SHORTEST = 12
#: Modulus and base of the rolling hash.
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
#: Odd multiplier of the window hash.
_SPREAD = 0x9E3779B97F4A7C15
#: Bytes of texts that become Python objects at once.
HELD = 4_000_000

#: start, length and period of a run.
Run = tuple[int, int, int]


def repeated_stretches(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal stretches (start, stop) covered by windows that occur twice, or whose hash does."""
    if len(ids) < 2 * window:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_SPREAD)
    mixed ^= mixed >> np.uint64(29)
    windows = len(ids) - window + 1
    hashed = np.zeros(windows, np.uint64)
    for k in range(window):
        hashed = hashed * np.uint64(_SPREAD) + mixed[k : k + windows]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    if not same.any():
        return []
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    edges = np.flatnonzero(np.diff(twice) > window)
    starts, stops = np.concatenate([twice[:1], twice[edges + 1]]), np.concatenate([twice[edges], twice[-1:]]) + window
    return list(zip(starts.tolist(), stops.tolist()))


class Periods:
    """Where the words of a stretch equal those at a distance after them."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.words, self.raw = ids, ids.tolist(), ids.astype("<u4").tobytes()
        self.sums, self.powers = [0], [1]
        for word in self.words:
            self.sums.append((self.sums[-1] * _BASE + word + 1) % _PRIME)
            self.powers.append(self.powers[-1] * _BASE % _PRIME)
        self.known: dict[int, tuple[int, int]] = {}

    def _alike(self, i: int, j: int, length: int) -> bool:
        sums, power = self.sums, self.powers[length]
        return (sums[i + length] - sums[i] * power - sums[j + length] + sums[j] * power) % _PRIME == 0

    def _longest(self, most: int, alike: Callable[[int], bool]) -> int:
        """The largest length up to ``most`` that is alike, as all below are: doubled, then halved."""
        low, step = 0, 1
        while low + step <= most and alike(low + step):
            low, step = low + step, step * 2
        high = min(most + 1, low + step)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if alike(middle) else (low, middle)
        return low

    def _equal(self, i: int, j: int, length: int) -> bool:
        return self.raw[4 * i : 4 * (i + length)] == self.raw[4 * j : 4 * (j + length)]

    def around(self, at: int, distance: int) -> tuple[int, int]:
        """The maximal stretch of positions around ``at``, itself one, whose words recur ``distance`` later."""
        start, stop = self.known.get(distance, (0, 0))
        if start <= at < stop:
            return start, stop
        other = at + distance
        after = self._longest(len(self.words) - other, lambda n: self._alike(at, other, n))
        before = self._longest(at, lambda n: self._alike(at - n, other - n, n))
        if not self._equal(at - before, other - before, before + after):
            differs = self.ids[:-distance] != self.ids[distance:]
            after = int(np.argmax(np.append(differs[at:], True)))
            before = int(np.argmax(np.append(differs[:at][::-1], True)))
        self.known[distance] = at - before, at + after
        return self.known[distance]


def _scan(periods: Periods, shortest: int, reverse: bool) -> Iterator[Run]:
    """Runs that the Lyndon words of one order give; a suffix is less than those that it begins."""
    words, around, n = periods.words, periods.around, len(periods.words)
    stack = [n]
    for i in range(n - 1, -1, -1):
        first = words[i]
        while (j := stack[-1]) < n:
            a, b = first, words[j]
            if a == b:
                stop = around(i, j - i)[1]
                if stop + j - i >= n:
                    break  # the later suffix begins the earlier one
                a, b = words[stop], words[stop + j - i]
            if (a < b) == reverse:
                break
            stack.pop()
        stack.append(i)
        if j < n and first == words[j]:
            start, stop = around(i, j - i)
        elif i and words[i - 1] == words[j - 1]:
            start, stop = around(i - 1, j - i)
        else:
            continue
        if stop - start >= max(j - i, shortest - (j - i)):
            yield start, stop - start + j - i, j - i


def runs_of(ids: np.ndarray, shortest: int = SHORTEST) -> list[Run]:
    """All runs of at least ``shortest`` words (2 or more) and two periods, by start, then period."""
    found = set()
    for begin, end in repeated_stretches(ids, max(1, shortest // 2)):
        periods = Periods(ids[begin:end])
        for reverse in (False, True):
            found.update((begin + start, length, period) for start, length, period in _scan(periods, shortest, reverse))
    return sorted(found, key=lambda run: (run[0], run[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that any run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def split(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8; bytes.split() parts at the six white-space bytes alone."""
    return (text or b"").split()


def _each_text(docs: DataFrame, row: Callable[[int | None, bytes | None], Iterator[tuple]], schema: str, shape: pa.Schema) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches, 1, HELD):
            rows = [r for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in row(doc_id, text)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), shape)] if rows else [pa.array([], f.type) for f in shape], schema=shape)

    return picked(docs, doc_id="long", text="binary").mapInArrow(made, schema)


def find_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, start, length and period (in words) of every run of every row of ``docs`` (doc_id, text).

    Null and empty texts have no words and no runs. Very long texts are read
    whole; repeated rows give their runs again; other columns are ignored.
    """
    shape = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "period")])
    return _each_text(docs, lambda doc_id, text: ((doc_id, *run) for run in runs_of(numbered(split(text)), shortest)), "doc_id long, start long, length long, period long", shape)


def collapse(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id and text of every row of ``docs``, each run cut to its first period and words joined by one space."""

    def row(doc_id: int | None, text: bytes | None) -> Iterator[tuple]:
        words = split(text)
        yield doc_id, b" ".join(kept_words(words, runs_of(numbered(words), shortest))).decode()

    return _each_text(docs, row, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def with_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with, in a tenth of the documents, a tail made periodic; ids draw which, where and how. Null ids draw none."""
    drawn, kind = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if doc_id is None or kind or not words:
        return words
    start = drawn % len(words)
    period = 1 + (len(words) - start) // (3 + drawn % 8)
    return words[:start] + [words[start + k % period] for k in range(len(words) - start)]


def digest(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Runs and collapsed words of every row of ``docs`` (doc_id, text), with periodic tails drawn by ``with_tail``.

    doc_id, n_runs; start, length, period and exponent_milli (thousandths of
    periods) of the longest run, null without one; runs_sha256 of all runs and
    collapsed_sha256 of the kept words. Null and empty texts have no words;
    repeated rows give a row each, very long texts are read whole, other
    columns are ignored, an empty table gives no rows.
    """

    def row(doc_id: int | None, text: bytes | None) -> Iterator[tuple]:
        words = with_tail(split(text), doc_id)
        runs = runs_of(numbered(words), shortest)
        listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = None if period is None else 1000 * length // period
        yield doc_id, len(runs), start, length, period, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()

    longs, texts = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli"), ("runs_sha256", "collapsed_sha256")
    shape = pa.schema([(name, pa.int64()) for name in longs] + [(name, pa.string()) for name in texts])
    return _each_text(docs, row, ", ".join([f"{n} long" for n in longs] + [f"{n} string" for n in texts]), shape)
