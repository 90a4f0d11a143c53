"""FM-index over integer symbols: wavelet-tree ranks, backward search and sampled positions, in NumPy.

The text is a row of runs of symbols >= 1, each run ended by symbol 0; the
separators differ from each other and sort by position.  All searches are
vectorised over patterns and occurrences.
"""

from __future__ import annotations

import numpy as np

#: every so many symbols of a run, its start included, a suffix position is kept
SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, compared up to and including their run's separator (prefix doubling)."""
    n = len(text)
    at = np.arange(n)
    sep = np.flatnonzero(text == 0)
    end = sep[np.searchsorted(sep, at)]                     # the separator of each position's run
    bits = max(1, int(text.max()).bit_length()) if n else 1
    h = max(1, 62 // bits)
    key = np.zeros(n, np.uint64)
    for s in range(h):                                       # the first h symbols, 0 beyond the run
        sym = np.where(at + s <= end, text[np.minimum(at + s, n - 1)], 0).astype(np.uint64)
        key = (key << np.uint64(bits)) | sym
    longest = int((end - at).max()) + 1 if n else 0
    while True:
        order = np.argsort(key, kind="stable")               # ties keep text order, as their separators do
        if h >= longest:
            return order
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, k[1:] != k[:-1])) + 1
        nxt = np.where(at + h <= end, rank[np.minimum(at + h, n - 1)], 0)
        key = rank.astype(np.uint64) * np.uint64(n + 2) + nxt.astype(np.uint64)
        h *= 2


class WaveletTree:
    """Level-wise wavelet matrix; ``rank(c, i)``: occurrences of c in the first i symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.bits = max(1, int(symbols.max()).bit_length()) if self.n else 1
        self.ones, self.zeros = [], []
        s = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])   # stable partition

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, i = np.zeros_like(i), i.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((c >> b) & 1).astype(bool)
            rs, ri = ones[start], ones[i]
            start = np.where(one, zeros + rs, start - rs)
            i = np.where(one, zeros + ri, i - ri)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, its occurrences before i)."""
        start, i, c = np.zeros_like(i), i.copy(), np.zeros_like(i)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = (ones[i + 1] - ones[i]).astype(bool)
            rs, ri = ones[start], ones[i]
            start = np.where(one, zeros + rs, start - rs)
            i = np.where(one, zeros + ri, i - ri)
            c = (c << 1) | one
        return c, i - start


class FMIndex:
    def __init__(self, text: np.ndarray):
        """text: int64 symbols, not empty, its last symbol 0."""
        n = len(text)
        order = suffix_order(text)
        self.tree = WaveletTree(text[order - 1])             # the symbol before each suffix
        self.before = np.append(0, np.cumsum(np.bincount(text)))   # symbols smaller than c
        sep = np.flatnonzero(text == 0)
        starts = np.append(0, sep + 1)
        offset = np.arange(n) - starts[np.searchsorted(sep, np.arange(n))]
        sampled = (offset % SAMPLE == 0)[order]
        self.sample_rank = np.append(0, np.cumsum(sampled))
        self.sampled = sampled
        self.samples = order[sampled]
        self.n = n

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns (rows of symbols, filled up with -1), by backward search."""
        count = len(patterns)
        lo, hi = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        live = np.arange(count)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[lengths[live] >= back]
            c = patterns[live, lengths[live] - back]
            known = (c > 0) & (c < len(self.before) - 1)
            hi[live[~known]] = lo[live[~known]] = 0
            live, c = live[known], c[known]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hit = hi > lo
        lo[~hit] = hi[~hit] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one (never across a separator)."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            done = self.sampled[r]
            out[todo[done]] = self.samples[self.sample_rank[r[done]]] + steps[todo[done]]
            todo, r = todo[~done], r[~done]
            if len(todo):
                c, k = self.tree.access_rank(r)
                rows[todo] = self.before[c] + k
                steps[todo] += 1
        return out
