"""FM-index over whole-number symbols, with a wavelet matrix of bit vectors.

The index holds no text and no suffix array: only the Burrows-Wheeler transform
as packed bit vectors with a rank count every 64 bits, symbol counts, and
running weights of the suffixes. All searches are done side by side on arrays.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes sorted by (at least) their first depth symbols,
    by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order, h = np.argsort(rank, kind="stable"), 1
    while h < depth:
        nxt = np.zeros(n, np.int64)
        nxt[:-h] = rank[h:] if h < n else 0
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[1], 1 + np.cumsum(k[1:] != k[:-1])])
        rank[order] = new
        if new[-1] == n:
            break
        h *= 2
    return order


class WaveletMatrix:
    """Rank queries over a sequence of symbols, one bit vector a level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(len(bit) - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.first = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            low = (_ONE << (at & 63).astype(np.uint64)) - _ONE
            ones = self.ranks[k].take(word) + np.bitwise_count(self.bits[k].take(word) & low)
            bit = (symbol >> (self.levels - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._down(symbol, at) - self.first.take(symbol)


class FMIndex:
    """Index of texts over symbols 1, 2, ...; 0 ends every text. weights: what
    an occurrence that starts at each place counts."""

    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int):
        self.symbols = int(text.max()) + 1
        order = suffix_order(text, depth)
        self.wavelet = WaveletMatrix(text[order - 1], self.symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int, least_weight: int = 2) -> np.ndarray:
        """For every end place in text, the length, up to most, of the longest
        stretch that ends there and whose occurrences weigh at least
        least_weight. Backward search, all ends side by side."""
        out = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.weight) - 1, np.int64)
        for d in range(most):
            c = text[ends[live] - d]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            first = self.before.take(c)
            lo, hi = first + both[: len(c)], first + both[len(c) :]
            good = (c > 0) & (self.weight.take(hi) - self.weight.take(lo) >= least_weight)
            live, lo, hi = live[good], lo[good], hi[good]
            out[live] = d + 1
            if not len(live):
                break
        return out
