"""A sparse suffix array: suffixes at content-selected places only, sorted, compared with neighbours and extended.

The places are those of each piece's anchor, the word k-gram with the least hash in its windows, so any repeated window
has one at the same offset in each of its copies. Suffixes are sorted by the words to their right; neighbours that share
so many of them form a run, and those of a run that also share the words to the left hold an equal window.
"""

from __future__ import annotations

import numpy as np

from threadlake.llm.packed import firsts, grams, mix, running_min


def _context(words: np.ndarray, at: np.ndarray, steps: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """words[at + step] for each step; -1 outside [low, high)."""
    place = at[:, None] + steps[None, :]
    inside = (place >= low[:, None]) & (place < high[:, None])
    return np.where(inside, words[np.clip(place, 0, len(words) - 1)], -1)


def matcher(width: int, gram: int):
    span = width - gram + 1

    def run(words: np.ndarray, piece: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """The least place of an equal window for each word that begins one, else -1."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n:
            return found
        length = np.bincount(piece)
        end = np.cumsum(length)
        # The anchor of a window is its least k-gram; here k-grams of known words are hashed anew.
        word_hash = mix(words.astype(np.uint64) + np.uint64(1))
        hashes = grams(word_hash, gram)
        hashes = np.append(hashes, np.zeros(n - len(hashes), np.uint64))
        least = running_min(np.append(hashes, np.zeros(span - 1, np.uint64)), span)[:n]
        starts = np.flatnonzero(offset + width <= length[piece])  # where windows begin
        # The first place of each window's least k-gram: a suffix to keep.
        nearest = np.full(len(starts), -1, np.int64)
        for k in range(span - 1, -1, -1):
            at = np.minimum(starts + k, n - 1)
            nearest = np.where(hashes[at] == least[starts], at, nearest)
        kept = np.unique(nearest)
        # One suffix array over kept places, by the words to the right.
        low, high = (end - length)[piece[kept]], end[piece[kept]]
        right = _context(words, kept, np.arange(width), low, high)
        order = np.lexsort(right[:, ::-1].T)
        kept, low, right = kept[order], low[order], right[order]
        differ = np.ones((len(kept), width), bool)
        differ[1:] = right[1:] != right[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), width)  # words in common with the neighbour before
        shared[0] = 0
        del right, differ
        nth = np.full(n, -1, np.int64)
        nth[kept] = np.arange(len(kept))
        suffix, left = nth[nearest], nearest - starts
        by_left = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(span + 1))
        powers = np.cumprod(np.full(span + 1, 0x9E3779B97F4A7C15, np.uint64))
        behind = np.zeros(len(kept), np.uint64)  # hash of the `back` words to the left of each suffix
        for back in range(span):
            if back:
                at = kept - back
                behind = behind + np.where(at >= low, word_hash[np.maximum(at, 0)], np.uint64(0)) * powers[back]
            windows = by_left[bounds[back] : bounds[back + 1]]
            if not len(windows):
                continue
            runs = np.cumsum(shared < width - back)
            s = suffix[windows]
            key = mix(behind[s] ^ mix(runs[s].astype(np.uint64)))
            sort = np.lexsort((starts[windows], key))
            head = firsts(key[sort])
            first = np.repeat(starts[windows][sort][head], np.diff(np.append(head, len(sort))))
            found[starts[windows][sort]] = first
        return found

    return run
