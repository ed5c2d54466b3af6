"""Substring de-duplication of documents: by FM-indexes (windows that an earlier document has) and by sparse suffix
arrays (passages that occur at an earlier place).

Results of both: a null or empty text has no words; texts shorter than a window are kept whole; rows with one id
are one document, and each of its texts gets its own result; rows with a null id are compared with nothing; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadlake.llm import fm_index, sparse_suffixes
from threadlake.llm.packed import Words, parts, unpacked, words_of
from threadlake.llm.passages import repeats


def _joined(words: Words, row: int, kept: np.ndarray | None = None) -> bytes:
    """The words of a row, those with kept if given, joined by single spaces."""
    at = np.arange(words.first[row], words.first[row + 1])
    if kept is not None:
        at = at[kept]
    if not len(at):
        return b""
    lengths = words.end[at] - words.start[at] + 1
    upto = np.cumsum(lengths)
    place = np.repeat(words.start[at], lengths) + np.arange(upto[-1]) - np.repeat(upto - lengths, lengths)
    out = words.data[np.minimum(place, len(words.data) - 1)].copy()
    out[upto - 1] = 0x20
    return out[:-1].tobytes()


def digest(texts: pa.Array) -> pa.Array:
    """SHA-256 of each text's words joined by single spaces."""
    words = words_of(texts)
    return pa.array([hashlib.sha256(_joined(words, r)).hexdigest() for r in range(len(texts))], pa.string())


def _no_digest(texts: pa.Array) -> pa.Array:
    return pa.nulls(len(texts), pa.string())


def without_earlier_windows(docs: DataFrame, width: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans): each document without the words of windows of `width` words that a
    document with a smaller id has too. spans: (start, end) of removed words."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = repeats(rows, width, gram, fm_index.matcher(width), True, digest)
    found = found.select("id", "n_words", "text", "digest", F.col("runs.word").alias("at"), F.col("runs.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                words = words_of(part.column(2))
                removed, sums, spans = [], [], []
                done = part.column(3).to_pylist()
                for r, (at, n) in enumerate(zip(part.column(4).to_pylist(), part.column(5).to_pylist())):
                    size = words.first[r + 1] - words.first[r]
                    edges = np.zeros(size + 1, np.int64)
                    if at:
                        np.add.at(edges, np.array(at), 1)
                        np.add.at(edges, np.array(at) + np.array(n) + width - 1, -1)
                    gone = np.cumsum(edges)[:size] > 0
                    removed.append(int(gone.sum()))
                    sums.append(done[r] or hashlib.sha256(_joined(words, r, ~gone)).hexdigest())
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(spans, kind)], ["id", "n_words", "n_removed", "kept_sha256", "spans"])

    out = found.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def repeated_passages(docs: DataFrame, width: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_words, first_id, first_start): passages, of `width` words or more, of a document whose windows of
    `width` words all occur at an earlier place of one document, with a smaller id or further up in the same one.
    first_start is where the passage's first window occurs first. Passages of a document may overlap by less than a
    window."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = repeats(rows, width, gram, sparse_suffixes.matcher(width, gram), False, _no_digest).filter("runs IS NOT NULL")
    fields = [F.col(f"runs.{f}").alias(f) for f in ("word", "n", "src_id", "src_word")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = []
            for key, *lists in zip(*(c.to_pylist() for c in batch.columns)):
                upto = None
                for word, n, src, src_word in zip(*lists):
                    if upto == word and out[-1][3] == src:
                        out[-1][2] += n
                    else:
                        out.append([key, word, n + width - 1, src, src_word])
                    upto = word + n
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], ["id", "start", "n_words", "first_id", "first_start"])

    out = found.select("id", *fields).mapInArrow(run, "id long, start long, n_words long, first_id long, first_start long")
    return out.withColumnsRenamed({"id": id_col, "first_id": f"first_{id_col}"})
