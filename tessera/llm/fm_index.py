"""Compressed FM-index over integer sequences: a wavelet matrix with packed bits and rank counts.

Built for patterns of bounded length: suffixes are sorted by their first `order` symbols, which is all
that backward search for patterns of up to `order` - 1 symbols needs. All searches take many patterns
at once.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        size = (len(bits) >> 6) + 1
        padded = np.zeros(size * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(size, dtype=np.uint32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:], dtype=np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones in bits[:i]."""
        at = i >> 6
        low = self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at].astype(np.int64) + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int):
        self.levels: list[tuple[BitRank, int]] = []
        self.height = max(1, int(sigma - 1).bit_length())
        now = values
        for level in range(self.height - 1, -1, -1):
            bits = ((now >> level) & 1).astype(np.uint8)
            zeros = len(bits) - int(bits.sum())
            self.levels.append((BitRank(bits), zeros))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _walk(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        for depth, (bits, zeros) in enumerate(self.levels):
            one = bits.ones(place)
            up = (symbols >> (self.height - 1 - depth)) & 1
            place = np.where(up == 1, zeros + one, place - one)
        return place

    def rank(self, symbols: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before position i and before position j."""
        n = len(symbols)
        place = self._walk(np.concatenate([symbols, symbols]), np.concatenate([i, j]))
        start = self.start[symbols]
        return place[:n] - start, place[n:] - start


class FMIndex:
    """Index of several sequences of 64-bit symbols; matches never cross from one to the next.

    flat: the sequences in a row; bounds: sequence i is flat[bounds[i]:bounds[i + 1]].
    """

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, order: int):
        self.alphabet, codes = np.unique(flat, return_inverse=True)
        size = np.diff(bounds)
        n = len(flat) + len(size)  # a separator, symbol 0, follows each sequence
        text = np.zeros(n, dtype=np.int64)
        owner = np.repeat(np.arange(len(size)), size + 1)
        inside = np.ones(n, dtype=bool)
        inside[np.cumsum(size + 1) - 1] = False
        text[inside] = codes + 1
        self.sigma = len(self.alphabet) + 1
        rank, span = text, 1
        while True:
            kinds = int(rank.max(initial=0)) + 2
            width = 3 if kinds < 1 << 20 else 2  # ranks packed into one key
            key = rank * 1
            for k in range(1, width):
                key *= kinds
                key[: max(0, n - k * span)] += rank[k * span :] + 1
            span *= width
            if span >= order:
                break
            rank = np.unique(key, return_inverse=True)[1]
        suffixes = np.argsort(key, kind="stable")
        self.owner = owner[suffixes]  # document array
        self.first = np.searchsorted(text[suffixes], np.arange(self.sigma + 1))
        self.wavelet = WaveletMatrix(text[suffixes - 1], self.sigma)
        self.size = n

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Symbol numbers in the index, -1 where it lacks them."""
        if not len(self.alphabet):
            return np.full(len(symbols), -1)
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at + 1, -1)

    def extend(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        before, upto = self.wavelet.rank(codes, low, high)
        start = self.first[codes]
        return start + before, start + upto

    def matching_statistics(self, flat: np.ndarray, bounds: np.ndarray, cap: int, least: int = 1, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of the streamed sequences the length, up to cap, of the longest run ending
        there that the index holds, and the interval of the suffixes that begin with that run.

        least: leaves out (with length 0) places that end no run of that length. own: the streamed
        sequences are the indexed ones, so an interval of one suffix is the place itself: it counts as
        cap symbols (where there are so many) and is extended no further.
        """
        codes = self.codes(flat)
        n = len(codes)
        length = np.zeros(n, dtype=np.int64)
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.size, dtype=np.int64)
        begin = np.repeat(bounds[:-1], np.diff(bounds))
        active = np.flatnonzero(np.arange(n) - begin >= least - 1)
        for step in range(cap):
            active = active[active - step >= begin[active]]
            symbol = codes[active - step]
            active, symbol = active[symbol > 0], symbol[symbol > 0]
            a, b = self.extend(symbol, low[active], high[active])
            held = a < b
            active, a, b = active[held], a[held], b[held]
            low[active], high[active], length[active] = a, b, step + 1
            if own:
                alone = b - a == 1
                length[active[alone]] = np.minimum(cap, active[alone] - begin[active[alone]] + 1)
                active = active[~alone]
            if not len(active):
                break
        return length, low, high

    def least(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The least values[owner] over each interval, which must not be empty; intervals must be equal
        or disjoint, as those of patterns of one length are, or hold one suffix."""
        held = np.append(values[self.owner], np.iinfo(np.int64).max)
        out = held[low]
        wide = np.flatnonzero(high - low > 1)
        starts, back = np.unique(low[wide], return_inverse=True)
        stops = np.zeros(len(starts), dtype=np.int64)
        stops[back] = high[wide]
        if len(wide):
            out[wide] = np.minimum.reduceat(held, np.stack([starts, stops], axis=1).reshape(-1))[::2][back]
        return out
