"""A compressed FM-index over an integer text: Burrows-Wheeler transform in a
wavelet matrix of packed bits with rank samples, searched backwards for many
patterns at once.

The suffixes are ordered by their first ``depth`` symbols, which makes
searches for patterns of up to ``depth`` symbols exact.
"""

from __future__ import annotations

import numpy as np

_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols, by prefix doubling. Symbol 0
    stands after the end too."""
    n = len(text)
    bits = max(1, int(text.max(initial=0)).bit_length())
    span = max(1, min(63 // bits, depth))
    key = np.zeros(n, dtype=np.int64)
    for j in range(span):
        key <<= bits
        key[:n - j] |= text[j:] if j < n else 0
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        if span >= depth or rank.max(initial=0) == n:
            return order
        key = rank << 32
        key[:max(0, n - span)] |= rank[span:]
        span *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int):
        text = text.astype(np.int64)
        n = len(text)
        order = suffix_order(text, depth)
        sequence = text[order - 1]      # the symbol before each suffix; the last one's before the first
        top = int(text.max(initial=0))
        self.levels = max(1, top.bit_length())
        counts = np.bincount(text, minlength=top + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.words, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.ranks.append(np.cumsum(ones) - ones)
            self.zeros.append(n - int(bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.base = np.zeros(top + 1, dtype=np.int64)
        self.base = self._down(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the sequence leads for ``symbol``."""
        for i, (words, ranks, zeros) in enumerate(zip(self.words, self.ranks, self.zeros)):
            word = at >> 6
            ones = ranks[word] + np.bitwise_count(words[word] & _BELOW[at & 63])
            at = np.where((symbol >> (self.levels - 1 - i)) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of ``symbol`` followed by the patterns of [low, high)."""
        n = len(symbol)
        at = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.first[symbol] - self.base[symbol]
        return at[:n] + shift, at[n:] + shift

    def repeated_from(self, text: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Matching statistics: for each place, the least ``q >= low`` for which
        ``text[q:end]`` occurs at least twice; ``end`` if even its last symbol
        does not. ``text`` is any array of symbols of the index."""
        q = end.copy()
        active = np.flatnonzero(q > low)
        symbol = text[q[active] - 1]
        lo, hi = self.first[symbol], self.first[symbol + 1]
        while len(active):
            go = hi - lo >= 2
            active, lo, hi = active[go], lo[go], hi[go]
            q[active] -= 1
            more = q[active] > low[active]
            active, lo, hi = active[more], lo[more], hi[more]
            if len(active):
                lo, hi = self.extend(text[q[active] - 1], lo, hi)
        return q


def repeated_windows(index: FMIndex, text: np.ndarray, start: np.ndarray, length: np.ndarray,
                     window: int) -> list[list[tuple[int, int]]]:
    """For pieces ``text[start:start+length]`` that are part of the index: the
    runs (first, last) of window starts, relative to the piece, whose window
    occurs at least twice.

    From the right end, the statistics of the last open window's end settle
    all windows of a repeated stretch at once; from the left, a window that is
    unique because of ``text[p:end]`` settles all windows up to p."""
    lo, hi = start.copy(), start + length - window
    found: list[list[tuple[int, int]]] = [[] for _ in start]
    active = np.flatnonzero(lo <= hi)
    while len(active):
        q = index.repeated_from(text, lo[active], hi[active] + window)
        yes = q <= hi[active]
        for i, a, b in zip(active[yes].tolist(), q[yes].tolist(), hi[active][yes].tolist()):
            found[i].append((a - int(start[i]), b - int(start[i])))
        hi[active] = np.where(yes, q, hi[active]) - 1
        active = active[lo[active] <= hi[active]]
        if not len(active):
            break
        q = index.repeated_from(text, lo[active], lo[active] + window)
        yes = q <= lo[active]
        for i, a in zip(active[yes].tolist(), q[yes].tolist()):
            found[i].append((a - int(start[i]), a - int(start[i])))
        lo[active] = np.where(yes, lo[active] + 1, q)
        active = active[lo[active] <= hi[active]]
    return found
