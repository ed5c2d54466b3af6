"""Finding passages that occur twice: the stages that the FM-index and the sparse suffix array share.

A window is `width` consecutive words of one document. Its anchor is the least hash among its word k-grams, so equal
windows have equal anchors; consecutive windows with one anchor form a piece, a fifth of the windows or fewer.

1. Anchors that one document has alone are found and left: each task packs its (anchor, document) pairs into buckets;
   of documents that share an anchor within a task's slice of text, one stands for the others in the shuffle.
2. Documents with shared anchors keep their texts in a written table; the others only their digests.
3. Pieces with shared anchors go to shards by anchor, each different piece of a slice once. A shard builds its index
   and answers, for every window of every piece, its earliest place (document, word).
4. The answers are joined to the pieces' occurrences, a join that Spark can split where one piece is in a third of
   all documents, and gathered for each document.

What one task holds is a shard of different pieces; a passage with any number of copies is there once for each slice.
Words are known here by 40 bits of a mixed hash, so a window is known by 13 or more times as many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadlake.llm.packed import Words, dealt, firsts, grams, mix, packed, parts, running_min, unpacked, words_of
from threadlake.llm.storage import durable

SYMBOL_BYTES = 5
_SYMBOL = np.uint64((1 << (8 * SYMBOL_BYTES)) - 1)
#: Shards for each shuffle partition: an index takes some 100 times the memory of its packed words.
SHARDS = 4
#: Windows of a piece at most; longer runs of one anchor, as in periodic text, are cut.
PIECE_WINDOWS = 64
_ROW = np.uint64(0x9E3779B97F4A7C15)


class Pieces(NamedTuple):
    row: np.ndarray
    start: np.ndarray  # first word, counted over the slice
    windows: np.ndarray
    anchor: np.ndarray


def pieces_of(words: Words, hashes: np.ndarray, width: int, gram: int) -> Pieces:
    least = running_min(grams(hashes, gram), width - gram + 1)
    n = len(least)
    row = words.row[:n]
    whole = np.flatnonzero(np.arange(n) + width <= words.first[row + 1])
    row, least = row[whole], least[whole]
    begin = firsts(row, least)
    count = np.diff(np.append(begin, len(whole)))
    if len(begin) and count.max() > PIECE_WINDOWS:
        cuts = -(-count // PIECE_WINDOWS)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin, count = np.repeat(begin, cuts) + nth * PIECE_WINDOWS, np.repeat(count, cuts) - nth * PIECE_WINDOWS
        count = np.minimum(count, PIECE_WINDOWS)
    return Pieces(row[begin], whole[begin], count, least[begin])


def _anchored_twice(found: Pieces, hashes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Whether the first and the last window of a piece have their anchor at different places: only then can a piece
    that is alone hold two equal windows."""
    values = grams(hashes, gram)

    def first_place(start: np.ndarray) -> np.ndarray:
        place = np.full(len(start), -1, np.int64)
        for k in range(width - gram, -1, -1):
            place = np.where(values[start + k] == found.anchor, start + k, place)
        return place

    return first_place(found.start) != first_place(found.start + found.windows - 1)


def shared_anchors(docs: DataFrame, width: int, gram: int, across: bool, buckets: int) -> DataFrame:
    """(id, anchors binary): a document's anchors that other documents have too, or, unless
    across, that occur twice anywhere."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                words = words_of(part.column(1))
                hashes = words.hashes() & _SYMBOL
                found = pieces_of(words, hashes, width, gram)
                ids = part.column(0).to_numpy(zero_copy_only=False)[found.row]
                order = np.lexsort((ids, found.anchor))
                ids, anchors = ids[order], found.anchor[order]
                if across:
                    keep = firsts(anchors, ids)
                    ids, anchors = ids[keep], anchors[keep]
                twice = np.zeros(len(anchors), bool) if across else _anchored_twice(found, hashes, width, gram)[order]
                heads = firsts(anchors)
                size = np.diff(np.append(heads, len(anchors)))
                is_head = np.zeros(len(anchors), bool)
                is_head[heads] = True
                several = size > 1
                if len(heads):
                    several |= np.logical_or.reduceat(twice, heads)
                known = np.repeat(several, size)  # shared already within this slice
                # The last bit says so of a head; anchors lose theirs, which only makes a candidate more.
                marked = (anchors[heads] & ~np.uint64(1)) | several
                order, bounds = dealt(marked >> np.uint64(8), buckets)
                rest = np.flatnonzero(known & ~is_head)
                bucket = np.append(np.arange(buckets), int(mix(anchors[:1])[0] % np.uint64(buckets)) if len(anchors) else 0)
                bounds = np.append(bounds, len(heads) + len(rest))
                full = np.flatnonzero(np.diff(bounds))
                bounds = np.append(bounds[full], bounds[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[full], pa.int32()), pa.array(full < buckets), packed(np.append(ids[heads][order], ids[rest]), bounds), packed(np.append(marked[order], anchors[rest] & ~np.uint64(1)), bounds)],
                    ["bucket", "head", "ids", "anchors"],
                )

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            head = batch.column(1).to_numpy(zero_copy_only=False)
            got, row = unpacked(batch.column(2), np.int64)
            marks, _ = unpacked(batch.column(3), np.uint64)
            direct = ~head[row]
            if direct.any():
                yield _by_part(got[direct], marks[direct], buckets)
            ids.append(got[~direct])
            anchors.append(marks[~direct])
        ids, marked = np.concatenate(ids), np.concatenate(anchors)
        order = np.argsort(marked)
        ids, marked = ids[order], marked[order]
        bare = marked & ~np.uint64(1)
        begin = firsts(bare)
        size = np.diff(np.append(begin, len(bare)))
        if len(bare):
            low, high = np.minimum.reduceat(ids, begin), np.maximum.reduceat(ids, begin)
            several = (low != high) if across else (size > 1)
            shared = np.repeat(several | (np.bitwise_or.reduceat(marked, begin) & np.uint64(1) > 0), size)
            yield _by_part(ids[shared], bare[shared], buckets)

    packs = docs.select("id", "text").mapInArrow(pack, "bucket int, head boolean, ids binary, anchors binary")
    found = packs.repartition(buckets, "bucket").mapInArrow(resolve, "part int, ids binary, anchors binary")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(unpacked(b.column(1), np.int64)[0], unpacked(b.column(2), np.uint64)[0]) for b in batches]
        if got:
            ids, anchors = (np.concatenate(c) for c in zip(*got))
            order = np.argsort(ids, kind="stable")
            ids, anchors = ids[order], anchors[order]
            begin = firsts(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[begin], pa.int64()), packed(anchors, np.append(begin, len(ids)))], ["id", "anchors"])

    return found.repartition(buckets, "part").mapInArrow(gather, "id long, anchors binary")


def _by_part(ids: np.ndarray, anchors: np.ndarray, n: int) -> pa.RecordBatch:
    """Packed rows for the n parts of all documents."""
    order, bounds = dealt(mix(ids.view(np.uint64)), n)
    full = np.flatnonzero(np.diff(bounds))
    bounds = np.append(bounds[full], bounds[-1])
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), packed(ids[order], bounds), packed(anchors[order], bounds)], ["part", "ids", "anchors"])


def _found(part: pa.RecordBatch, width: int, gram: int) -> tuple[Words, np.ndarray, Pieces]:
    """Words, hashes and the pieces with shared anchors of rows (id, text, anchors binary)."""
    words = words_of(part.column(1))
    hashes = words.hashes() & _SYMBOL
    found = pieces_of(words, hashes, width, gram)
    anchors, row = unpacked(part.column(2), np.uint64)
    key = lambda a, r: mix((a & ~np.uint64(1)) ^ (r.astype(np.uint64) * _ROW))
    keep = np.isin(key(found.anchor, found.row), key(anchors, row))
    return words, hashes, Pieces(*(x[keep] for x in found))


def _spelled(hashes: np.ndarray, found: Pieces, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of all pieces, each piece's length, and each piece's own hash."""
    length = found.windows + width - 1
    upto = np.cumsum(length)
    place = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - length, length)
    symbols = hashes[np.repeat(found.start, length) + place]
    return symbols, length, _own(symbols, length)


def _own(symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash for each of the pieces that stand one after another in symbols."""
    upto = np.cumsum(length)
    if not len(upto):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int(length.max()), _ROW, np.uint64))
    total = np.cumsum(mix(symbols) * powers[np.arange(upto[-1]) - np.repeat(upto - length, length)])
    sums = total[upto - 1]
    sums[1:] -= total[upto[:-1] - 1]
    return mix(sums ^ mix(length.astype(np.uint64)))


def _symbols(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // SYMBOL_BYTES, 8), np.uint8)
    wide[:, :SYMBOL_BYTES] = raw.reshape(-1, SYMBOL_BYTES)
    return wide.view(np.uint64).reshape(-1)


#: (words as small numbers, piece of each word, offset of each word in its piece) -> for each word that begins a
#: window, the least place in words of an equal window; -1 elsewhere. Pieces come in order of (document, word).
Matcher = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def earliest(docs: DataFrame, width: int, gram: int, matcher: Matcher, shards: int) -> DataFrame:
    """docs: (id, text, anchors). (piece, offsets, counts, src_ids, src_words): for the windows of each different
    piece, in runs of `counts` windows from `offsets` on, the earliest place at which an equal window begins."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                words, hashes, found = _found(part, width, gram)
                if not len(found.row):
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False)[found.row]
                begin = found.start - words.first[found.row]
                _, _, own = _spelled(hashes, found, width)
                order = np.lexsort((begin, ids, own))
                order = order[firsts(own[order])]
                order = order[dealt(found.anchor[order] >> np.uint64(8), shards)[0]]
                _, bounds = dealt(found.anchor[order] >> np.uint64(8), shards)
                few = Pieces(*(x[order] for x in found))
                symbols, length, _ = _spelled(hashes, few, width)
                ends = np.concatenate([[0], np.cumsum(length)])
                full = np.flatnonzero(np.diff(bounds))
                bounds = np.append(bounds[full], bounds[-1])
                cut = symbols.view(np.uint8).reshape(-1, 8)[:, :SYMBOL_BYTES].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), packed(ids[order], bounds), packed(begin[order].astype(np.int32), bounds), packed(length.astype(np.uint16), bounds), packed(cut, ends[bounds] * SYMBOL_BYTES)],
                    ["shard", "ids", "begin", "length", "symbols"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(4)]
        kinds = (np.int64, np.int32, np.uint16, np.uint8)
        for batch in batches:
            for k, kind in enumerate(kinds):
                cols[k].append(unpacked(batch.column(k + 1), kind)[0])
        if not cols[0]:
            return
        ids, begin, length, raw = (np.concatenate(c) for c in cols)
        begin, length = begin.astype(np.int64), length.astype(np.int64)
        del cols
        at = np.cumsum(length) - length
        own = _own(_symbols(raw), length)
        order = np.lexsort((begin, ids, own))
        order = order[firsts(own[order])]  # each different piece once, at its first place
        order = order[np.lexsort((begin[order], ids[order]))]
        own, ids, begin, length, at = (x[order] for x in (own, ids, begin, length, at))
        ends = np.cumsum(length)
        piece = np.repeat(np.arange(len(own), dtype=np.int32), length)
        offset = (np.arange(ends[-1]) - np.repeat(ends - length, length)).astype(np.int32)
        _, words = np.unique(_symbols(raw), return_inverse=True)
        words = words[np.repeat(at, length) + offset].astype(np.int32)
        del raw
        least = matcher(words, piece, offset)
        at = np.flatnonzero(least >= 0)
        least, piece, offset_of = least[at], piece[at], offset
        src = np.searchsorted(ends, least, "right")
        word = begin[src] + offset_of[least]
        step = np.ones(len(at), bool)
        step[1:] = (piece[1:] != piece[:-1]) | (ids[src[1:]] != ids[src[:-1]]) | (word[1:] != word[:-1] + 1)
        run = np.flatnonzero(step)
        count = np.diff(np.append(run, len(at)))
        of = firsts(piece[run])
        lists = pa.array(np.append(of, len(run)), pa.int32())
        listed = lambda v, kind: pa.ListArray.from_arrays(lists, pa.array(v, kind))
        whole = pa.RecordBatch.from_arrays(
            [pa.array(own[piece[run[of]]].view(np.int64)), listed(offset_of[at[run]], pa.int64()), listed(count, pa.int64()), listed(ids[src[run]], pa.int64()), listed(word[run], pa.int64())],
            ["piece", "offsets", "counts", "src_ids", "src_words"],
        )
        for k in range(0, whole.num_rows, 20_000):
            yield whole.slice(k, 20_000)

    packs = docs.select("id", "text", "anchors").mapInArrow(pack, "shard int, ids binary, begin binary, length binary, symbols binary")
    return packs.repartition(shards, "shard").mapInArrow(answer, "piece long, offsets array<long>, counts array<long>, src_ids array<long>, src_words array<long>")


def occurrences(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """docs: (id, text, anchors, own). (piece, id, own, word): where each piece with a shared anchor begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                words, hashes, found = _found(part, width, gram)
                if len(found.row):
                    ids = part.column(0).to_numpy(zero_copy_only=False)[found.row]
                    own = _spelled(hashes, found, width)[2]
                    texts = part.column(3).take(pa.array(found.row))
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(ids, pa.int64()), texts, pa.array(found.start - words.first[found.row], pa.int64())], ["piece", "id", "own", "word"])

    return docs.select("id", "text", "anchors", "own").mapInArrow(run, "piece long, id long, own long, word long")


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs (id, text) with own: 0, or for an id that has several texts a hash of the text."""
    several = docs.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).filter("low <> high")
    several = durable(several.select("id", F.lit(True).alias("several")), "ids-of-several-texts")
    if several.isEmpty():
        return docs.select("id", "text", F.lit(0).cast("long").alias("own"))
    return docs.join(several, "id", "left").select("id", "text", F.when(F.col("several"), F.xxhash64("text")).otherwise(0).alias("own"))


def repeats(docs: DataFrame, width: int, gram: int, matcher: Matcher, across: bool, digest: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """(id, n_words, text, digest, runs) of docs (id, text). runs: (word, n, src_id, src_word), n windows from `word` on that
    occur first at src_id, src_word, a smaller id if across, else an earlier place. text only if there can be runs; else
    digest is digest(text). Rows with a null id have none."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = _told_apart(docs)
    anchors = shared_anchors(docs.filter("id IS NOT NULL"), width, gram, across, n)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                n_words = words_of(part.column(1)).counts()
                alone, texts = part.column(2).is_null().to_pylist(), part.column(1).to_pylist()
                sums = digest(pa.array([t if a else None for t, a in zip(texts, alone)], pa.string()))
                sums = pa.array([x if a else None for x, a in zip(sums.to_pylist(), alone)], pa.string())
                text = pa.array([None if a else t for t, a in zip(texts, alone)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), text, part.column(2), part.column(3), pa.array(n_words, pa.int64()), sums], ["id", "text", "anchors", "own", "n_words", "digest"])

    joined = docs.join(anchors, "id", "left").select("id", "text", "anchors", "own")
    kept = durable(joined.mapInArrow(split, "id long, text string, anchors binary, own long, n_words long, digest string"), "passages")
    twice = kept.filter("anchors IS NOT NULL")
    answers = earliest(twice, width, gram, matcher, SHARDS * n)
    earlier = "s.src < id" if across else "s.src < id OR s.src = id AND s.src_word < word + s.at"
    zipped = F.arrays_zip(F.col("offsets").alias("at"), F.col("counts").alias("n"), F.col("src_ids").alias("src"), F.col("src_words").alias("src_word"))
    placed = occurrences(twice, width, gram).join(answers.select("piece", zipped.alias("runs")), "piece")
    runs = placed.select("id", "own", "word", F.explode("runs").alias("s")).filter(earlier)
    runs = runs.groupBy("id", "own").agg(F.array_sort(F.collect_set(F.struct((F.col("word") + F.col("s.at")).alias("word"), F.col("s.n").alias("n"), F.col("s.src").alias("src_id"), F.col("s.src_word").alias("src_word")))).alias("runs"))
    return kept.drop("anchors").join(runs, ["id", "own"], "left").drop("own")
