"""FM-index over a sequence of integer symbols: wavelet-matrix ranks and sampled suffix positions, in numpy.

All searches are of many phrases at once: a step of backward search is a few
array operations for every phrase that still has a range.
"""

from __future__ import annotations

import numpy as np


class BitRanks:
    """A bit vector with ``ones(i)``, the number of ones before place i."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks and access over symbols 0 .. 2^levels - 1."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows = levels, []
        for k in range(levels - 1, -1, -1):
            bits = ((symbols >> k) & 1).astype(bool)
            self.rows.append((BitRanks(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(i)
        for k, (bits, zeros) in enumerate(self.rows):
            up = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(up, zeros + a, start - a), np.where(up, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for bits, zeros in self.rows:
            up = bits.get(i).astype(bool)
            ones = bits.ones(i)
            symbol, i = symbol * 2 + up, np.where(up, zeros + ones, i - ones)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by doubling; a suffix that ends first comes first."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
    step = 1
    while n and rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        step *= 2
    return order


class FMIndex:
    """Counts and locates phrases. Symbols are positive; 0 ends the sequence and may separate its parts."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        symbols = np.append(np.asarray(symbols, np.int64), 0)
        n, self.sample = len(symbols), sample
        order = suffix_array(symbols)
        bwt = symbols[order - 1]
        top = int(symbols.max())
        self.size, self.sigma = n, top
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        self.bwt = WaveletMatrix(bwt, max(1, top.bit_length()))
        kept = (order % sample == 0) | (bwt == 0)  # a walk never has to cross a separator, whose copies ranks can't tell apart
        self.marks, self.places = BitRanks(kept), order[kept]

    def _before(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.bwt.rank(symbol, row)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges ``[lo, hi)`` of phrases, given as rows padded on the right."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.flatnonzero(lengths > 0)
        hi[lengths <= 0] = 0
        at = np.asarray(lengths, np.int64) - 1
        while len(live):
            symbol = phrases[live, at[live]].astype(np.int64)
            there = symbol <= self.sigma
            hi[live[~there]] = lo[live[~there]]
            live, symbol = live[there], symbol[there]
            lo[live], hi[live] = self._before(symbol, lo[live]), self._before(symbol, hi[live])
            at[live] -= 1
            live = live[(hi[live] > lo[live]) & (at[live] >= 0)]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffixes by row: steps back to the nearest sampled place."""
        rows = np.array(rows, np.int64)
        out, steps, todo = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo):
            here = rows[todo]
            found = self.marks.get(here).astype(bool)
            done = todo[found]
            out[done] = self.places[self.marks.ones(here[found])] + steps[done]
            todo, here = todo[~found], here[~found]
            symbol = self.bwt.access(here)
            rows[todo] = self._before(symbol, here)
            steps[todo] += 1
        return out
