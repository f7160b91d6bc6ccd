"""A compressed FM-index over word ids in numpy, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of text in order, by prefix doubling.

    All suffixes must differ within their first `depth` symbols.
    """
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        k *= 2
        if new[-1] == n - 1 or k >= depth:
            return order
        rank[order] = new


class WaveletMatrix:
    """A wavelet tree, level by level, with bits packed in 64-bit words and a count before each word."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.words, self.before, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view("<u8")
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.begin = self._down(np.arange(1 << levels), np.zeros(1 << levels, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.begin[symbol]


class FMIndex:
    """Backward search over pieces of text; every piece ends with a separator of its own."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        """words: the pieces' words, one piece after the other; each piece at most 62 words."""
        pieces = len(lengths)
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths)
        text = np.empty(len(words) + pieces, np.int64)
        at = np.arange(len(words)) + np.repeat(np.arange(pieces), lengths)
        text[at] = ids + pieces
        text[ends + np.arange(pieces)] = np.arange(pieces)
        self.ids, self.start, self.length = text, np.concatenate([[0], ends[:-1]]) + np.arange(pieces), lengths
        order = suffix_array(text, int(lengths.max(initial=1)) + 2)
        top = pieces + len(self.vocabulary)
        self.size = len(text)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(top).bit_length()))

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the patterns with a symbol put before each."""
        both = self.less[np.concatenate([symbol, symbol])] + self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return both[: len(symbol)], both[len(symbol) :]

    def extend(self, base: np.ndarray, end: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each pattern text[base + x : base + end] the smallest x >= least at which it still occurs twice or more.

        Each lane is one pattern; a lane stops where one more word to the left leaves fewer than two occurrences.
        """
        x = end.copy()
        lane = np.flatnonzero(end > least)
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), self.size)
        while len(lane):
            lo, hi = self.back(self.ids[base[lane] + x[lane] - 1], lo, hi)
            going = hi - lo >= 2
            lane, lo, hi = lane[going], lo[going], hi[going]
            x[lane] -= 1
            going = x[lane] > least[lane]
            lane, lo, hi = lane[going], lo[going], hi[going]
        return x

    def repeated(self, pieces: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start, end) of the longest stretches of `window` words or more that occur elsewhere too.

        The matching statistic of an end is the longest stretch up to it with two occurrences or more. Every end that
        some window could have is covered: after a stretch [i, e) has stopped, no window may hold [i - 1, e); if even
        [i - 1, i - 1 + g) occurs only once, the next end is i - 2 + g.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        piece, base, end = pieces, self.start[pieces], self.length[pieces].copy()
        zero = np.zeros(len(piece), np.int64)
        while len(piece):
            x = self.extend(base, end, zero)
            hit = end - x >= window
            found.append((piece[hit], x[hit], end[hit]))
            next_end = end - 1
            open_ = np.flatnonzero(x > 0)
            for g in (1, 2, 4, 8, 16):
                open_ = open_[x[open_] - 1 + g < end[open_]]
                if not len(open_):
                    break
                left = x[open_] - 1
                alone = self.extend(base[open_], left + g, left) > left
                next_end[open_[alone]] = left[alone] + g - 1
                open_ = open_[~alone]
            keep = (x > 0) & (next_end >= window)
            piece, base, end, zero = piece[keep], base[keep], next_end[keep], zero[keep]
        return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
