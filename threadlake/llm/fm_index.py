"""A compressed FM-index over words, and matching statistics by backward search in it.

The Burrows-Wheeler transform lies in a wavelet matrix of packed bits with a count for each 64 of them. Suffixes are
sorted to the window's length, which keeps backward search exact for patterns up to that length. Each streamed piece is
read from its end: the interval of the window is extended by the word before it and contracted by its last word, so a
window costs one backward step; an interval above the threshold (a whole window long) is a match.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n, self.levels = len(symbols), max(1, int(n_symbols - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            blocks = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(blocks).astype(np.int32)
            self.bits.append(blocks)
            self.before.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.bits[level][block] & mask)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place `at`."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.levels):
            one = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            ends = self._ones(k, np.concatenate([low, high]))
            low_ones, high_ones = ends[: len(at)], ends[len(at) :]
            low = np.where(one, self.zeros[k] + low_ones, low - low_ones)
            high = np.where(one, self.zeros[k] + high_ones, high - high_ones)
        return high - low


class FmIndex:
    """Of a text of whole numbers from 0 on; 0 ends each piece and is never searched."""

    def __init__(self, text: np.ndarray, width: int):
        self.width, n = width, len(text)
        rank, done, shorter = text.astype(np.int64), 1, None
        order = np.argsort(rank, kind="stable")
        # Ranks by the first 1, 2, 4 .. words, then by width - 1 and width of them.
        while done < width:
            by = min(done, width - 1 - done) or 1
            after = np.zeros(n, np.int64)
            after[: n - by] = rank[by:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])]) if n else np.zeros(0, np.int64)
            if done == width - 1:
                shorter = rank
            rank = np.empty(n, np.int64)
            rank[order] = new
            done += by
        if shorter is None:
            shorter = np.zeros(n, np.int64)
        self.places = order
        ranks = rank[order]
        self.heads = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if n else order  # first of those with the same `width` words
        # Of the suffixes with the same first width - 1 words: the first and the one after the last.
        edge = np.concatenate([[True], shorter[order][1:] != shorter[order][:-1]]) if n else np.zeros(0, bool)
        heads = np.flatnonzero(edge)
        run = np.cumsum(edge) - 1
        self.wide_low, self.wide_high = heads[run].astype(np.int32), np.append(heads[1:], n)[run].astype(np.int32)
        self.sigma = int(text.max()) + 1 if n else 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.tree = WaveletMatrix(text[order - 1], self.sigma)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each symbol followed by the pattern of [low, high)."""
        both = self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        start = self.less[symbols]
        return start + both[: len(low)], start + both[len(low) :]

    def contract(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of a window without its last word."""
        return self.wide_low[low].astype(np.int64), self.wide_high[low].astype(np.int64)


def matcher(width: int):
    def run(words: np.ndarray, piece: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """The least place of an equal window for each word that begins one, else -1."""
        n, k = len(words), int(piece[-1]) + 1 if len(piece) else 0
        length = np.bincount(piece, minlength=k)
        end = np.cumsum(length)
        text = np.zeros(n + k, np.int32)
        text[np.arange(n) + piece] = words + 1
        at_text = end + np.arange(k)  # the end mark of each piece
        index = FmIndex(text, width)
        least = np.minimum.reduceat(index.places, index.heads) if n else index.places
        found = np.full(n, -1, np.int64)
        low, high, live = np.zeros(k, np.int64), np.full(k, len(text), np.int64), np.arange(k)
        for step in range(1, int(length.max()) + 1 if k else 0):
            more = length[live] >= step
            live, low, high = live[more], low[more], high[more]
            if step > width:
                low, high = index.contract(low)
            low, high = index.extend(text[at_text[live] - step], low, high)
            if step >= width:  # every interval holds its own piece at least
                found[end[live] - step] = least[np.searchsorted(index.heads, low, "right") - 1]
        hit = found >= 0
        found[hit] -= np.searchsorted(at_text, found[hit], "right")  # less the end marks before it
        return found

    return run
