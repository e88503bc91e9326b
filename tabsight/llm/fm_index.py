"""FM-index over a sequence of small integers, in NumPy.

The index holds the Burrows-Wheeler transform of the sequence in a wavelet
matrix (one bit vector with block counts for each bit of a symbol) and, for
``locate``, the sequence places of sampled rows.  Patterns are searched
backwards, many at a time: every step is a few array operations over all
patterns that still occur.
"""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of codes >= 1 (a suffix that is the
    beginning of another comes first).  First as many symbols as fit into 62
    bits are compared, then the compared length doubles; only suffixes that
    still share their group are sorted again."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length()) if n else 1
    packed = max(1, 62 // bits)
    key = codes.astype(np.int64)
    for j in range(1, packed):
        key <<= bits
        key[:max(0, n - j)] |= codes[j:]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    places = shared_places(new)
    h = packed
    while len(places):
        at = order[places]
        behind = at + h
        key = rank[at] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[places] = at
        new = np.ones(len(places), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        places = places[shared_places(new)]
        h *= 2
    return order


def shared_places(new: np.ndarray) -> np.ndarray:
    """Places whose group (``new`` marks first members) has other members."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


class BitVector:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletMatrix:
    """Rank and access for a sequence of symbols below ``2 ** bits``."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            one = (symbols >> b) & 1 > 0
            zeros = symbols[~one]
            self.levels.append((b, BitVector(one), len(zeros)))
            symbols = np.concatenate([zeros, symbols[one]])
        self.first = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> b) & 1 > 0, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before place ``at``."""
        return self._down(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at the place, how often it occurs before)."""
        symbol = np.zeros(len(at), np.int64)
        for b, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            symbol |= one.astype(np.int64) << b
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


class FMIndex:
    """Index of a sequence of codes >= 1; every ``sample``-th place is kept."""

    def __init__(self, codes: np.ndarray, n_codes: int, sample: int = 8):
        order = np.concatenate([[len(codes)], suffix_order(codes)])  # the empty suffix comes first
        last = np.where(order > 0, codes[order - 1] if len(codes) else 0, 0)  # 0 ends the sequence
        self.n, bits = len(order), max(1, int(n_codes).bit_length())
        self.matrix = WaveletMatrix(last, bits)
        count = np.bincount(last, minlength=1 << bits)
        self.smaller = np.cumsum(count) - count
        kept = order % sample == 0
        self.kept, self.places = BitVector(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern; patterns are the last ``lengths``
        entries of the rows of a matrix."""
        width = patterns.shape[1]
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(width - 1, -1, -1):
            live = live[(width - lengths[live] <= j) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = patterns[live, j]
            low[live] = self.smaller[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.matrix.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of index rows: each is followed backwards to
        a row whose place is kept."""
        out, steps = np.empty(len(rows), np.int64), 0
        at, todo = rows, np.arange(len(rows))
        while len(todo):
            known = self.kept.get(at)
            out[todo[known]] = self.places[self.kept.ones(at[known])] + steps
            todo, at = todo[~known], at[~known]
            symbol, before = self.matrix.access(at)
            at = self.smaller[symbol] + before
            steps += 1
        return out
