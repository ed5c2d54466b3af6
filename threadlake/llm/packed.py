"""Words of many texts at once, over Arrow buffers: offsets, 64-bit hashes, windows and the anchors that route them.

A word is a run of bytes other than white space, so UTF-8 needs no decoding. Its hash is a polynomial over its bytes,
mixed; a window's hash is a polynomial over the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose result bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Words(NamedTuple):
    data: np.ndarray  # the bytes of all texts
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    row: np.ndarray  # the text of each word
    first: np.ndarray  # of each text, its first word; one entry more than texts

    def hashes(self) -> np.ndarray:
        lengths = self.end - self.start
        if not len(lengths):
            return np.zeros(0, np.uint64)
        upto = np.cumsum(lengths)
        place = np.arange(upto[-1]) - np.repeat(upto - lengths, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
        total = np.cumsum(_BYTE[self.data[np.repeat(self.start, lengths) + place]] * powers[place])
        sums = total[upto - 1]
        sums[1:] -= total[upto[:-1] - 1]
        return mix(sums)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: pa.Array) -> Words:
    """texts: strings; a null has no words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SEPARATOR[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(offsets, start, "right") - 1, np.searchsorted(start, offsets, "left"))


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the words [i, i + width) for each i that has so many."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, width):
        total = total * _STEP + hashes[k : k + n]
    return mix(total)


def running_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for each i."""
    n, done = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while done < width:
        by = min(done, width - done)
        values = np.minimum(values[:-by], values[by:])
        done += by
    return values[:n]


def parts(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about limit bytes of text at most; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at, upto = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows, but for the last, of batches that a session's setting may have made short."""
    waiting, n = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the bytes of values[bounds[i] : bounds[i + 1]]."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((np.asarray(bounds, np.int64) * values.itemsize).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows' bytes, and the row of each; nulls have none."""
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    if not sizes.sum():
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(bytes(memoryview(data)[offsets[0] : offsets[-1]]), kind), np.repeat(np.arange(len(column)), sizes)


def dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys of one bucket of n together, and the n + 1 bounds of the buckets in it."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])


def firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)
