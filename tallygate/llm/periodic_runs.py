"""Periodic run detection: maximal stretches of words that repeat with a period, and the text without the repeats.

A run of smallest period q has at least ``least`` and at least ``power`` * q words. The words of some documents, each
document closed by a word that occurs nowhere else, are one sequence x with

* its suffix array and LCP array, from ranks of the windows of 1, 2, 4, ... words (doubling). These ranks also tell how
  far two places agree onwards or backwards, for many pairs at once;
* the longest-previous-factor array, from these two by taking suffixes out of the list from the last to the first;
* its Lempel-Ziv blocks: each is the longest factor that also starts earlier, or a new word.

A run that ends in a block and starts before it is found by Main's extensions from the border b between them: with p
words of it on one side of b, what agrees with itself p words further, onwards and backwards, is the run. If it began p
or more words before the previous block, that block would have been longer; so p is less than (both blocks' length) /
(power - 1). Runs that touch a border are found there as well. A run strictly inside a block has neighbours in it, so
its copy at the block's source is a run already: runs, in buckets by their start, are copied from left to right.

Two thirds or more of a run agree with what is q words further. So a document with a run holds a window of
least * (power - 1) / power words twice, and only such documents go through the above; others have no runs.

Words are compared exactly. A task holds some 150 bytes a word of its longest text. Null and empty texts have no words
and no runs; rows are judged one by one, so repeated rows give repeated results, and a null doc_id is carried along.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, shingles, small, texts

#: A stretch (start, length, period) of words.
Run = tuple[int, int, int]
#: Words of the documents that are searched together, about.
SLICE = 200_000
_SPAN = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("runs", _SPAN), ("kept", pa.string())])


class Words(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Ranks:
    """Ranks of the windows of 2^k words of a sequence that ends in a unique word, as far as windows are alike."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        rank, distinct = self._dense(x)
        self.levels, width = [rank], 1
        while distinct < self.n:
            after = np.zeros(self.n, np.int64)
            after[:-width] = rank[width : self.n] + 1
            rank, distinct = self._dense(rank[: self.n].astype(np.int64) * (self.n + 1) + after)
            self.levels.append(rank)
            width *= 2

    @staticmethod
    def _dense(x: np.ndarray) -> tuple[np.ndarray, int]:
        values, rank = np.unique(x, return_inverse=True)
        return np.append(rank.astype(np.int32), np.int32(-1)), len(values)

    def suffix_array(self) -> np.ndarray:
        out = np.empty(self.n, np.int64)
        out[self.levels[-1][: self.n]] = np.arange(self.n)
        return out

    def onwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, for pairs of places i != j."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i, j, total = i + step, j + step, total + step
        return total

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i equal those up to j; none where one is before the first word."""
        low, apart = np.minimum(i, j) + 1, np.abs(i - j)
        total = np.zeros(len(low), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            at = low - total - (1 << k)
            a = np.maximum(at, 0)
            total += ((at >= 0) & (self.levels[k][a] == self.levels[k][a + apart])).astype(np.int64) << k
        return total

    def alike(self, i: np.ndarray, j: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Whether the windows of 2^level words at i and j are equal; False where one is out of the sequence."""
        out = np.zeros(len(i), bool)
        fits = (np.minimum(i, j) >= 0) & (np.maximum(i, j) < self.n) & (level < len(self.levels))
        for k in np.unique(level[fits]):
            at = np.flatnonzero(fits & (level == k))
            out[at] = self.levels[k][i[at]] == self.levels[k][j[at]]
        return out


def previous_factors(sa: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """(LPF, where it starts): for each place the longest factor that also starts earlier. ``lcp[r]``: of suffixes r - 1 and r."""
    n = len(sa)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    rank, order, lcp = rank.tolist(), [*sa.tolist(), -1], [*lcp.tolist(), 0]
    before, after = list(range(-1, n)), [*range(1, n + 1), n]
    longest, source = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        p, q, a = before[r], after[r], lcp[r]
        b = lcp[q]
        if a >= b:
            longest[i], source[i], lcp[q] = a, order[p], b
        else:
            longest[i], source[i], lcp[q] = b, order[q], a
        before[q] = p
        if p >= 0:
            after[p] = q
    return longest, source


def _blocks(longest: list[int]) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end."""
    starts, at = [], 0
    while at < len(longest):
        starts.append(at)
        at += longest[at] or 1
    return np.array([*starts, at], np.int64)


def _at_borders(ranks: Ranks, starts: np.ndarray, least: int, power: int) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of the runs that cross or touch the start of a block."""
    size = np.diff(starts)
    left, right = size, np.append(size[1:], 0)  # of each border but the first place, the blocks on either side
    border = starts[1:]
    use = left + right >= least * (power - 1) // power
    left, right, border = left[use], right[use], border[use]
    found: dict[tuple[int, int], int] = {}

    def periods(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(border, p) for each p from 1 to that border's most."""
        b = np.repeat(border, most)
        return b, np.arange(1, len(b) + 1) - np.repeat(np.cumsum(most) - most, most)

    for side in (-1, 0):
        b, p = periods((left + right) // (power - 1) if side else right)
        near, far = b + side * p, b + (side + 1) * p
        half = ((power - 1) * p + 1) // 2  # so many words at least agree onwards, or backwards
        level = np.frexp(half.astype(np.float64))[1].astype(np.int64) - 1
        wide = np.left_shift(1, level)
        some = (near >= 0) & (ranks.alike(near, far, level) | ranks.alike(near - wide, far - wide, level))
        near, far, p = near[some], far[some], p[some]
        f, g = ranks.onwards(near, far), ranks.backwards(near - 1, far - 1)
        run = f + g + p >= np.maximum(least, power * p)
        for s, e, q in zip((near - g)[run].tolist(), (far + f)[run].tolist(), p[run].tolist(), strict=True):
            found[s, e] = min(q, found.get((s, e), q))
    return found


def runs_of(x: np.ndarray, least: int = 24, power: int = 3) -> list[Run]:
    """All runs of a sequence of numbers whose last occurs once, by start and period."""
    ranks = Ranks(x)
    sa = ranks.suffix_array()
    lcp = np.append(0, ranks.onwards(sa[:-1], sa[1:]))
    longest, source = previous_factors(sa, lcp)
    starts = _blocks(longest)
    buckets: dict[int, dict[int, int]] = defaultdict(dict)
    for (s, e), q in _at_borders(ranks, starts, least, power).items():
        buckets[s][e] = q
    for b, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if end - b <= least:
            continue
        by = b - source[b]
        for s in range(b + 1, end - least):
            for e, q in buckets[s - by].items() if s - by in buckets else ():
                if e + by < end:
                    buckets[s][e + by] = q
    return sorted(((s, e - s, q) for s, ends in buckets.items() for e, q in ends.items()), key=lambda r: (r[0], r[2]))


def _suspects(ids: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the documents in which a window of ``width`` words may stand twice: all in which one does."""
    if len(ids) < width:
        return np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
    h = (shingles(mixed, width) ^ (doc[: len(doc) - width + 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))[at]
    order = np.argsort(h, kind="stable")
    twice = np.flatnonzero(h[order][1:] == h[order][:-1])
    return np.unique(doc[at[order[twice]]])


def runs_of_documents(documents: list[list[bytes]], least: int = 24, power: int = 3) -> list[list[Run]]:
    """The runs of each document, a list of words."""
    number, out = Words(), [[] for _ in documents]
    ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in documents]
    ends = np.cumsum([len(w) for w in ids])
    some = _suspects(np.concatenate(ids) if ids else np.empty(0, np.int64), ends, least - least // power)
    at = 0
    while at < len(some):
        taken, words = [], 0
        while at < len(some) and (not taken or words + len(ids[some[at]]) <= SLICE):
            taken.append(int(some[at]))
            words += len(ids[some[at]]) + 1
            at += 1
        x = np.concatenate([np.append(ids[d], len(number) + k) for k, d in enumerate(taken)])
        place = np.cumsum([0, *(len(ids[d]) + 1 for d in taken)])
        for s, n, q in runs_of(x, least, power):
            k = int(np.searchsorted(place, s, "right")) - 1
            out[taken[k]].append((s - int(place[k]), n, q))
    return out


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone), strict=False) if not g]


def periodic_runs(docs: DataFrame, least: int = 24, power: int = 3) -> DataFrame:
    """(doc_id, runs, kept): every document's runs by start and period, and its words that no run repeats, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 250):
            words = [t.split() for t in texts(batch)]
            runs = runs_of_documents(words, least, power)
            kept = pa.array([b" ".join(without_repeats(w, r)) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
            spans = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], _SPAN)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans, kept], schema=_SCHEMA)

    return lean(docs).mapInArrow(run, "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string")


def best(runs: list[Run]) -> Run | None:
    """The run of greatest exponent, the first of equal ones."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def best_run() -> Column:
    """The same as a column over ``runs``: exponents are compared as products, in decimals."""
    wide = lambda x: x.cast("decimal(19,0)")
    more = lambda a, b: wide(a["length"]) * wide(b["period"]) > wide(b["length"]) * wide(a["period"])
    return F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda a, b: F.when(more(b, a), b).otherwise(a))


def repeated_stretch(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by crc32 of the doc_id, repeats a stretch of its words up to its end."""
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = lean(docs).select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    n = F.size("w")
    docs = docs.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    made = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i))), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))
