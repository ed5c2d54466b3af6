"""Links between documents whose sets of word n-grams are alike, by a prefix-tree join: exact, without lists of all pairs.

1. A document's n-grams, as 64-bit hashes, are put in one order for all documents, by a table of fixed size of how many
   have them. Two sets of Jaccard similarity s or more share m of the first n - ceil(s n) + m n-grams, the prefix, m being
   n / MORE. So a set can be left out if fewer of its prefix, by a tenth, are in another's prefix; this is looked at twice,
   as each set left out leaves n-grams alone. Documents with the same set are one: their least id stands for them.
2. A prefix n-gram that several sets have makes a cell of them. Most cells say the same: one whose sets all have another
   n-gram in common, of the TOPS in each one's prefix that most sets have, lies within that one's cell and is left out, as
   is one that has the same sets as another.
3. In a cell the sets, with their n-grams ordered by how many of the cell have them, form a trie. All sets of a block go
   down the trie together: at each node the overlap with the path so far is carried on, so that it is found once for all
   sets below, and the node's subtree is left when what remains of the set and of the longest set below cannot reach the
   overlap that the least similar size asks for. Where a set ends the overlap is exact.
4. Only links that join two classes are needed, so a subtree that lies in the set's own class is left too; the first
   blocks are small, and in a cell of a thousand variants of one text the rest is left at the root.
5. A cell of more than CELL n-grams is cut by classes of size, of which only neighbours can be alike, and then dealt over
   salts, each two of which meet in a cell of their own.

Classes are the connected components of the links. 64-bit hashes stand for n-grams and are not compared again.

Results: a document of fewer words than an n-gram has the sequence of all of them as its only one; without words (null or
empty text) it is linked with nothing; rows are told apart by id and set, so an id with several texts has a row for each,
and repeated rows get the same result; a row with a null id is linked with nothing and has no class; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadlake.llm.components import components
from threadlake.llm.joins import joined
from threadlake.llm.near_duplicates import COUNTERS, bags
from threadlake.llm.packed import firsts, gathered, mix, packed, parts, words_of
from threadlake.llm.storage import durable, forget, partitions

#: Two sets link when DEN * overlap >= NUM * union.
NUM, DEN, WIDTH = 90, 100, 3
#: One in so many n-grams more than needed are in a prefix.
MORE = 20
#: n-grams of each set that are tried as wider cells.
TOPS = 4
#: n-grams of a cell's sets, about; hot n-grams are those of more than one in HOT of all rows, so HOT of them at most.
CELL, HOT = 1 << 20, 1024
#: n-grams of one step down the trie; numbers of a block's table of which set has which n-gram.
STEP, TABLE = 32, 1 << 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.uint64(0x8CB92BA72F3D8DD7)


class _Sets(NamedTuple):
    row: np.ndarray  # of each n-gram, its text
    gram: np.ndarray
    size: np.ndarray  # of each text
    key: np.ndarray  # 128 bits of each text's set


def sets_of(texts: pa.Array, width: int = WIDTH) -> _Sets:
    words = words_of(texts)
    words = words._replace(data=_LOWER[words.data])
    row, gram, _ = bags(words, words.hashes(), width)
    size = np.bincount(row, minlength=len(texts))
    key = np.zeros((len(texts), 2), np.uint64)
    for lane in range(2):
        np.add.at(key[:, lane], row, mix(gram ^ mix(_SEED + np.uint64(lane))))
    return _Sets(row, gram, size, key)


def _least_overlap(size: np.ndarray) -> np.ndarray:
    return -(-NUM * size // DEN)


def _counter(gram: np.ndarray) -> np.ndarray:
    return (gram % np.uint64(COUNTERS)).astype(np.int64)


def gram_counts(texts: DataFrame) -> np.ndarray:
    """How many texts (text) have an n-gram, by counter: a table of COUNTERS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in parts(batch, 0):
                total += np.bincount(_counter(sets_of(part.column(0)).gram), minlength=COUNTERS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["counter", "n"])

    found = texts.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(rows: DataFrame) -> DataFrame:
    """(id, n, key, prefix) of rows (id, text): the number of n-grams, the set's key, and those of the prefix. Sets too
    small to be like another have no prefix."""
    shared = rows.sparkSession.sparkContext.broadcast(gram_counts(rows))
    least = next(n for n in range(1, 10_000) if DEN * n >= NUM * (n + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                found = sets_of(part.column(1))
                order = np.lexsort((found.gram, shared.value[_counter(found.gram)], found.row))
                begin = np.cumsum(found.size) - found.size
                place = np.arange(len(found.row)) - begin[found.row]
                length = np.where(found.size >= least, found.size - _least_overlap(found.size) - (-found.size // MORE), 0)
                kept = found.gram[order][place < length[found.row]].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(kept))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.size), pa.array([x.tobytes() for x in found.key], pa.binary()), lists], ["id", "n", "key", "prefix"])

    return rows.select("id", "text").mapInArrow(run, "id long, n long, key binary, prefix array<long>")


def _shared(posted: DataFrame) -> tuple[DataFrame, list[int]]:
    """posted (node, n, gram) with sets and weight, how many sets have it and their size together, without n-grams that one
    set alone has and without sets that have too few of the others; and the hot n-grams."""
    grams = durable(posted.groupBy("gram").agg(F.count("*").alias("sets"), F.sum("n").alias("weight")).filter("sets > 1"), "shared-grams")
    # No n-gram outside of this list has more than one in HOT of the rows, and a list of more than HOT cannot be.
    hot = [row.gram for row in grams.filter(F.col("sets") > F.lit(posted.count()) / HOT).select("gram").collect()]
    met = durable(joined(posted, grams, ["gram"], "gram", hot), "shared-prefix-grams")
    alive = met.groupBy("node").agg(F.count("*").alias("k"), F.first("n").alias("n")).filter(F.col("k") * MORE * DEN >= F.col("n") * NUM).select("node")
    return durable(met.join(alive.hint("shuffle_merge"), "node", "left_semi"), "shared-by-many"), hot


def cells(texts: DataFrame, cell: int = CELL) -> DataFrame:
    """(node, gram, part, low, high) of texts (node, n, prefix): the cells that each has to be in."""
    posted = durable(texts.select("node", "n", F.explode("prefix").alias("gram")), "prefix-grams")
    once, _ = _shared(posted)
    forget(posted)
    shared, hot = _shared(once.select("node", "n", "gram"))
    mine = F.struct("sets", "gram")
    tops = shared.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(mine), False), 1, TOPS).alias("tops"))
    lists = durable(shared.groupBy("gram").agg(F.bit_xor(F.xxhash64("node")).alias("digest"), F.min("node").alias("first"), F.count("*").alias("n"), F.max("weight").alias("weight")).filter("n > 1"), "lists")
    wider = shared.join(tops, "node").select("gram", mine.alias("mine"), F.explode("tops").alias("top")).filter("top > mine")
    wider = wider.groupBy("gram", "top").agg(F.count("*").alias("n")).join(lists.select("gram", "n"), ["gram", "n"], "left_semi").select("gram").distinct()
    kept = lists.join(wider, "gram", "left_anti")
    # Of n-grams with the same sets one is enough.
    kept = kept.groupBy("digest", "first", "n").agg(F.min_by(F.struct("gram", "weight"), "gram").alias("x")).select("x.gram", "x.weight")
    kept = durable(kept, "cells")
    met = joined(shared.select("node", "n", "gram"), kept, ["gram"], "gram", hot)
    size_class = F.floor(F.log("n") / math.log(DEN / NUM)).cast("int")
    part = F.when(F.col("weight") > cell, F.array(size_class, size_class - 1)).otherwise(F.array(F.lit(-1)))
    met = durable(met.select("node", "n", "gram", F.explode(part).alias("part")), "cell-members")
    # What is large is cut further: there are fewer such cells than n-grams of all sets divided by CELL.
    large = met.groupBy("gram", "part").agg(F.ceil(F.sum("n") / cell).cast("int").alias("salts")).filter("salts > 1")
    met = met.join(large, ["gram", "part"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    met = met.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return met.select("node", "gram", "part", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high")).distinct()


class _Trie:
    """Sets, each in the cell's order of n-grams, as a trie whose nodes are runs of at most STEP n-grams."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets])
        known, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, -count))] = np.arange(len(known))
        row = np.repeat(np.arange(len(sets)), size)
        flat = rank[at]
        flat = flat[np.lexsort((flat, row))]
        stop = np.cumsum(size)
        text = [flat[e - n : e].astype(">u4").tobytes() for e, n in zip(stop.tolist(), size.tolist())]
        self.order = np.array(sorted(range(len(sets)), key=text.__getitem__))
        self.ranks = [flat[stop[k] - size[k] : stop[k]] for k in self.order.tolist()]
        self.size, self.n_grams = size[self.order], len(known)
        self.flat = np.concatenate(self.ranks)
        self.start = np.cumsum(self.size) - self.size
        self._grow([0, *(self._common(a, b) for a, b in zip(self.ranks, self.ranks[1:]))])

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        return int(differ.argmax()) if differ.any() else n

    def _grow(self, common: list[int]) -> None:
        common = np.array(common)
        nodes, children, todo = [], [], [(0, len(self.size), 0, -1)]
        while todo:
            low, high, depth, parent = todo.pop()
            if parent >= 0:
                children[parent].append(len(nodes))
            branch = int(common[low + 1 : high].min()) if high - low > 1 else int(self.size[low])
            end = min(branch, depth + STEP)
            nodes.append((low, high, depth, end, self.size[low:high].min(), self.size[low:high].max()))
            children.append([])
            me = len(nodes) - 1
            if end < branch:
                todo.append((low, high, end, me))
            elif high - low > 1:
                cuts = [low, *(low + 1 + np.flatnonzero(common[low + 1 : high] == branch)).tolist(), high]
                todo.extend((a, b, end, me) for a, b in zip(cuts, cuts[1:]) if not (b - a == 1 and self.size[a] == end))
        self.low, self.high, self.depth, self.end, self.least, self.most = np.array(nodes).T
        self.n_children = np.array([len(c) for c in children])
        self.first_child = np.cumsum(self.n_children) - self.n_children
        self.children = np.array([c for cs in children for c in cs], np.int64)


def _bounds(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of the smallest and the largest set that one of this size can link with."""
    return -(-NUM * size // DEN), DEN * size // NUM


def trie_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of the sets, by number: enough to join each class, and none within a class."""
    if len(sets) < 2:
        return []
    trie, n, links = _Trie(sets), len(sets), []
    own = np.arange(n)  # the class of each set, in the trie's order
    at, block = 0, 1
    while at < n - 1:
        query = np.arange(at, min(n - 1, at + block))
        at, block = query[-1] + 1, max(1, min(2 * block, 256, TABLE // trie.n_grams))
        has = np.zeros((len(query), trie.n_grams), bool)
        for k, q in enumerate(query.tolist()):
            has[k, trie.ranks[q]] = True
        keys = np.concatenate([trie.ranks[q] + k * trie.n_grams for k, q in enumerate(query.tolist())])
        upto = np.cumsum(trie.size[query])
        low, high = _bounds(trie.size[query])
        changes = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        k, node, overlap = np.arange(len(query)), np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        found = []
        while len(k):
            q = query[k]
            last = trie.high[node] - 1
            alone = (changes[last] == changes[np.maximum(trie.low[node], q + 1).clip(max=n - 1)]) & (own[last] == own[q])
            live = (last > q) & ~alone & (np.maximum(trie.least[node], low[k]) <= np.minimum(trie.most[node], high[k]))
            k, node, overlap = k[live], node[live], overlap[live]
            if not len(k):
                break
            length = trie.end[node] - trie.depth[node]
            add = np.zeros(len(k), np.int64)
            for s in range(0, len(k), 1 << 15):
                some = slice(s, s + (1 << 15))
                span = length[some]
                place = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
                grams = trie.flat[np.repeat(trie.start[trie.low[node[some]]] + trie.depth[node[some]], span) + place]
                add[some] = np.bincount(np.repeat(np.arange(len(span)), span), has[np.repeat(k[some], span), grams], len(span))
            overlap = overlap + add
            q, end = query[k], trie.end[node]
            seen = np.where(end > 0, trie.flat[trie.start[trie.low[node]] + np.maximum(end, 1) - 1], -1)
            left = upto[k] - np.searchsorted(keys, k * trie.n_grams + seen, "right")
            first = trie.low[node]
            ends = (trie.size[first] == end) & (first > q) & ((NUM + DEN) * overlap >= NUM * (trie.size[q] + trie.size[first]))
            found.extend(zip(q[ends].tolist(), first[ends].tolist()))
            smallest = np.maximum(trie.least[node], low[k])
            reach = overlap + np.minimum(left, trie.most[node] - end)
            live = ((NUM + DEN) * reach >= NUM * (trie.size[q] + smallest)) & (trie.n_children[node] > 0)
            k, node, overlap = k[live], node[live], overlap[live]
            many = trie.n_children[node]
            child = np.repeat(trie.first_child[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            k, node, overlap = np.repeat(k, many), trie.children[child], np.repeat(overlap, many)
        for a, b in found:
            if own[a] != own[b]:
                links.append((int(trie.order[a]), int(trie.order[b])))
                own[own == own[b]] = own[a]
    return links


def links(rows: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b): links of texts (node, id, key, n, prefix), whose words are in rows (id, text), that join all classes."""
    wanted = cells(texts.select("node", "n", "prefix")).groupBy("node").agg(F.collect_list(F.struct("gram", "part", "low", "high")).alias("cells"))
    wanted = durable(wanted.join(texts.select("node", "id", "key"), "node"), "wanted")
    sides = rows.join(wanted.hint("shuffle_merge"), "id").select("text", "node", "key", "cells")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0):
                found = sets_of(part.column(0))
                right = np.array([k.tobytes() == w for k, w in zip(found.key, part.column(2).to_pylist())], bool)
                lists = packed(found.gram, np.concatenate([[0], np.cumsum(found.size)]))
                cells_of = part.column(3)
                of = np.repeat(np.arange(part.num_rows), np.diff(cells_of.offsets.to_numpy()))
                flat = cells_of.flatten()
                kept = np.flatnonzero(right[of])
                for s in range(0, len(kept), 256):
                    at = pa.array(kept[s : s + 256])
                    yield pa.RecordBatch.from_arrays([*(flat.field(f).take(at) for f in range(4)), part.column(1).take(pa.array(of[kept[s : s + 256]])), lists.take(pa.array(of[kept[s : s + 256]]))], ["gram", "part", "low", "high", "node", "grams"])

    cell = ["gram", "part", "low", "high"]
    met = sides.mapInArrow(spread, "gram long, part int, low int, high int, node long, grams binary")
    met = met.repartition(n, *cell).sortWithinPartitions(*cell, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joins(table: pa.Table, more: bool) -> tuple[pa.RecordBatch, pa.Table]:
            """Links in all cells but the last, if more rows come, and the rows of that."""
            begin = firsts(*(table.column(c).to_numpy() for c in cell))
            node, grams, out = table.column("node").to_numpy(), table.column("grams"), []
            stop = np.append(begin, table.num_rows)[1:]
            for b, e in list(zip(begin.tolist(), stop.tolist()))[: len(begin) - more]:
                once = b + firsts(node[b:e])
                out.extend((node[once[i]], node[once[j]]) for i, j in trie_links([np.frombuffer(grams[int(r)].as_py(), np.uint64) for r in once]))
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]), table.slice(begin[-1] if more else table.num_rows)

        rest, waiting, held = [], [], 0
        for batch in batches:
            waiting.append(batch)
            held += batch.nbytes
            if batch.num_rows and held > 1 << 23:
                out, rest = joins(pa.Table.from_batches(waiting), True)
                waiting, held = rest.to_batches(), 0
                yield out
        if sum(b.num_rows for b in waiting):
            yield joins(pa.Table.from_batches(waiting), False)[0]

    return met.mapInArrow(run, "a long, b long")


def alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each document: the size of its set and the least id that links lead to."""
    n = partitions(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = durable(prefixes(rows), "prefixes")
    firsts_of = known.filter("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.min_by("n", "id").alias("n"), F.min_by("prefix", "id").alias("prefix"))
    texts = durable(firsts_of.withColumn("node", F.monotonically_increasing_id()), "sets")
    labels = components(durable(links(rows, texts.filter("size(prefix) > 0"), n), "links"))
    ids = texts.select("node", "id", "key").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("id").alias("least"))
    of = ids.join(least, "component").select("key", "least")
    out = known.select("id", "n", "key").join(of, "key", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("least"))).otherwise(F.col("id")).alias("component_id"))
    return out
