"""Periodic runs of words by an enhanced suffix array.

The words of a stretch of documents become codes, and one suffix array orders
the suffixes of all of them, document by document.  The branching-tandem test
finds the squares: a run's rightmost square of period q starts at a suffix i
that shares exactly q words with suffix i + q, so both lie in one LCP interval
of depth q, in different children.  It is enough to look from all children
but the largest of each interval, forwards and backwards (ISA[i + q] and
ISA[i - q] in the interval's bounds); no tree is built.  Each square found is
rotated to the left as far as its period holds, which gives its run.

All steps are array operations over the whole stretch; the number of looks is
n log n at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cmp_to_key
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import byte_stretches
from tabsight.llm.fm_index import shared_places

ROTATE = 64  # words compared in one step to the left


class Run(NamedTuple):
    start: int
    length: int
    period: int


class SuffixArray:
    """Suffixes of several sequences in one array.  ``codes`` >= 1 with a 0
    behind each sequence; suffixes are ordered by sequence, then content, and
    end with their sequence."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        owner = np.cumsum(codes == 0) - (codes == 0)
        bits, owner_bits = int(codes.max()).bit_length(), int(owner[-1]).bit_length()
        self.codes, self.packed = codes, max(1, (62 - owner_bits) // max(1, bits))
        key, inside = owner.astype(np.int64), np.ones(n, bool)
        padded = np.append(codes, np.zeros(self.packed, codes.dtype))
        for j in range(self.packed):
            part = np.where(inside, padded[j:j + n], 0)
            key = (key << bits) | part
            inside &= part > 0
        order = np.argsort(key)
        key = key[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        self.ranks = [(self.packed, rank.astype(np.int32))]  # equal where that many words are equal
        places, h = shared_places(new), self.packed
        while len(places):
            at = order[places]
            key = rank[at] * (n + 1) + rank[at + h]  # at + h is in the sequence: the words before it occur again
            by = np.argsort(key)
            key, at = key[by], at[by]
            order[places] = at
            new = np.ones(len(places), bool)
            new[1:] = key[1:] != key[:-1]
            rank[at] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
            places, h = places[shared_places(new)], 2 * h
            self.ranks.append((h, rank.astype(np.int32)))
        self.order = order
        self.inverse = np.empty(n, np.int64)
        self.inverse[order] = np.arange(n)
        self.common = self._common(owner)

    def _common(self, owner: np.ndarray) -> np.ndarray:
        """Words that each suffix shares with the one before it in the order."""
        a, b = self.order[:-1], self.order[1:]
        lcp = np.zeros(len(self.order), np.int64)
        live = np.flatnonzero((self.codes[a] == self.codes[b]) & (owner[a] == owner[b])) + 1
        a, b, found = self.order[live - 1], self.order[live], np.zeros(len(live), np.int64)
        for h, rank in reversed(self.ranks):
            same = rank[a + found] == rank[b + found]
            found += h * same
        step = np.ones(len(live), bool)
        for _ in range(self.packed - 1):  # fewer words than the first ranks compare
            step &= self.codes[a + found] == self.codes[b + found]
            found += step
        lcp[live] = found
        return lcp


class _Minima:
    """Least values of stretches of 2^k entries."""

    def __init__(self, values: np.ndarray, longest: int):
        self.tables = [values]
        while 1 << len(self.tables) <= longest:
            half, last = 1 << (len(self.tables) - 1), self.tables[-1]
            nxt = last.copy()
            np.minimum(last[:-half], last[half:], out=nxt[:-half])
            self.tables.append(nxt)

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which all entries up to ``at`` are >= least."""
        at = at.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            to = at - (1 << k)
            ok = (to >= 0) & (self.tables[k][np.maximum(to, 0)] >= least)
            at = np.where(ok, to, at)
        return at

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place behind ``at`` whose entry is below ``least``."""
        n = len(self.tables[0])
        at = at + 1
        for k in range(len(self.tables) - 1, -1, -1):
            ok = (at + (1 << k) <= n) & (self.tables[k][np.minimum(at, n - 1)] >= least)
            at = np.where(ok, at + (1 << k), at)
        return at


def _looks(array: SuffixArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, depth, interval's first place, its last) for all suffixes in
    children of LCP intervals, without each interval's largest child."""
    lcp = array.common
    at = np.flatnonzero(lcp)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none
    # in one row: the entries > 0, with one 0 between stretches that do not touch
    gap = np.diff(at, prepend=at[0]) > 1
    place = np.arange(len(at)) + np.cumsum(gap)
    row = np.zeros(place[-1] + 1, np.int64)
    row[place] = lcp[at]
    back = np.zeros(len(row), np.int64)
    back[place] = at
    zeros = np.flatnonzero(row == 0)
    longest = int(np.diff(zeros, prepend=-1, append=len(row)).max())
    depth, minima = lcp[at], _Minima(row, longest)
    first = minima.left(place, depth)  # entries first … end - 1 are those of the interval
    end = minima.right(place, depth)
    after = minima.right(place, depth + 1)  # the child to the right of an entry: places at … after - 1
    low = back[first] - 1
    high = low + end - first  # rows low … high of the suffix array
    child_first, child_n = at, after - place
    # the leftmost child of an interval: its entry is the interval's first of that depth
    key = first * (int(depth.max()) + 1) + depth
    _, lead, group = np.unique(key, return_index=True, return_inverse=True)
    left_first, left_n = low[lead], at[lead] - low[lead]
    child = [np.concatenate(x) for x in ((child_first, left_first), (child_n, left_n), (depth, depth[lead]),
                                         (low, low[lead]), (high, high[lead]), (group, np.arange(len(lead))))]
    first, size, depth, low, high, group = child
    by = np.lexsort((size, group))
    largest = by[np.append(group[by][1:] != group[by][:-1], True)]
    keep = np.ones(len(first), bool)
    keep[largest] = False
    first, size, depth, low, high = (x[keep] for x in (first, size, depth, low, high))
    rows = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    return array.order[rows], *(np.repeat(x, size) for x in (depth, low, high))


def branching_squares(array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares whose next word breaks the period."""
    at, depth, low, high = _looks(array)
    codes, isa, n = array.codes, array.inverse, len(array.codes)
    found = []
    for start, other in ((at, at + depth), (at - depth, at - depth)):
        ok = (other >= 0) & (other < n)
        row = isa[np.clip(other, 0, n - 1)]
        ok &= (row >= low) & (row <= high)
        s, q = start[ok], depth[ok]
        branch = codes[s + q] != codes[s + 2 * q]  # the two suffixes share exactly q words
        found.append((s[branch], q[branch]))
    both = np.unique(np.concatenate([s * n + q for s, q in found]))
    return both // n, both % n


def _rotated(codes: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The leftmost start at which each square's period still holds.  The 0
    before a sequence equals the word one period later in no case."""
    start, live = start.copy(), np.arange(len(start))
    back = np.arange(1, ROTATE + 1)
    while len(live):
        s, q = start[live, None] - back, period[live, None]
        same = (s >= 0) & (codes[np.maximum(s, 0)] == codes[np.maximum(s + q, 0)])
        held = np.where(same.all(1), ROTATE, same.argmin(1))
        start[live] -= held
        live = live[held == ROTATE]
    return start


def merged(codes: np.ndarray, square: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of branching squares.  Of squares that
    end together the smallest period goes first; those that its run holds and
    whose period it divides repeat a shorter word and fall away, so that no
    stretch is rotated for each of its multiples."""
    by = np.lexsort((period, square + 2 * period))
    square, period = square[by], period[by]
    found = []
    while len(square):
        end = square + 2 * period
        head = np.ones(len(end), bool)
        head[1:] = end[1:] != end[:-1]
        group = np.cumsum(head) - 1
        start = _rotated(codes, square[head], period[head])
        found.append((start, end[head], period[head]))
        rest = ~head & ((period % period[head][group] > 0) | (square < start[group]))
        square, period = square[rest], period[rest]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (square, square, period)


def word_runs(sequences: list[list], least: int = 6, times: int = 4) -> list[list[Run]]:
    """For each sequence of words its runs of length >= max(least, times *
    period), each once with its smallest period, by start, then period."""
    sizes = np.array([len(x) for x in sequences], np.int64)
    out: list[list[Run]] = [[] for _ in sequences]
    if not sizes.sum():
        return out
    table: dict = {}
    number = table.setdefault
    codes = np.zeros(int(sizes.sum()) + len(sequences), np.int64)
    ends = np.cumsum(sizes + 1)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = False
    codes[inside] = np.fromiter((number(w, len(table) + 1) for x in sequences for w in x), np.int64, int(sizes.sum()))
    array = SuffixArray(codes)
    start, end, period = merged(codes, *branching_squares(array))
    long = end - start >= np.maximum(least, times * period)
    start, end, period = start[long], end[long], period[long]
    owner = np.searchsorted(ends, start, "right")
    first = ends[owner] - sizes[owner] - 1
    for k, s, n, q in zip(owner.tolist(), (start - first).tolist(), (end - start).tolist(), period.tolist()):
        out[k].append(Run(s, n, q))
    for runs in out:
        runs.sort(key=lambda r: (r.start, r.period))
    return out


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The words, of every tenth document (by the CRC-32 of its id as text)
    with a repeating end: each word i >= a is word a + (i - a) % p."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for r in runs:
        keep[r.start + r.period:r.start + r.length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; ties: smallest start, then period."""
    def before(a: Run, b: Run) -> int:
        return (b.length * a.period - a.length * b.period) or (a.start - b.start) or (a.period - b.period)
    return min(runs, key=cmp_to_key(before), default=None)


_RUN = "struct<start:long,length:long,period:long>"
_TYPES = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in Run._fields])), pa.string()]


def _worker(shard_bytes: int, change: Callable | None, least: int, times: int):
    def shard(part: pa.RecordBatch) -> pa.RecordBatch:
        words = [(t or "").encode("utf-8", "replace").split() for t in part.column(1).to_pylist()]
        if change:
            words = list(map(change, part.column(0).to_pylist(), words))
        found = word_runs(words, least, times)
        kept = [b" ".join(collapsed(w, r)) for w, r in zip(words, found)]
        columns = [pa.array([len(w) for w in words], _TYPES[0]), pa.array(found, _TYPES[1]),
                   pa.array([strongest(r) for r in found], _TYPES[1].value_type), pa.array(kept, pa.binary()).cast(_TYPES[2])]
        return pa.RecordBatch.from_arrays([part.column(0), *columns],
                                          names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_stretches(batch.column(1), shard_bytes):
                yield shard(batch.slice(a, b - a))
    return run


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4,
                  change: Callable | None = None, shard_bytes: int = 2_000_000) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, runs (start, length, period
    in words, by start, then period), strongest (the run with the greatest
    length / period; null without runs) and collapsed (the words that no run
    holds behind its first period, joined by one space).

    Words are split at ASCII white space.  A run is a longest stretch with
    its smallest period q and a length of at least max(``least``, ``times`` *
    q); ``times`` is 2 or more.  ``change(id, words)`` gives the words to read
    instead.  Null and empty texts have no word and no run; null and repeated
    ids pass through; an empty table gives no row; other columns are not read.
    Map-only; a task holds one Arrow batch and the arrays of ``shard_bytes``
    of text or of one longer text."""
    from tabsight.session import ship_package
    ship_package(df.sparkSession)
    kind = df.schema[id_col].dataType
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _worker(shard_bytes, change, least, times),
        f"doc_id {kind.simpleString()}, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string")


def run_report(df: DataFrame, **options) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the
    collapsed text."""
    out = periodic_runs(df, **options)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n"))))
    best = F.col("strongest")
    milli = F.expr("1000 * strongest.length div strongest.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
                      best["length"].alias("length"), best["period"].alias("period"), milli.alias("exponent_milli"),
                      F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
