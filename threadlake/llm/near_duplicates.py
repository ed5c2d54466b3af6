"""Near-duplicates by BagMinHash: weighted MinHash signatures of word shingles with their counts, bands and verification.

A shingle with count w owns the weights [0, w). Over each of the intervals [0, 1), [1, 2), [2, 4), [4, 8) .. runs a
Poisson process in time whose rate is the interval's length; a point falls on a register and, in an interval that w
cuts, on a discrete weight, and counts if that is below w. A register keeps its earliest point, so two texts agree on a
register with the probability of their weighted Jaccard similarity, sum of least over sum of greatest counts. Large
counts cost their logarithm, and points later than every register's first are never made.

Texts with the same words are one text: the least id stands for them. In each bucket of a band, members are compared
with its least and its greatest member, never all with each other, and all comparisons are exact multiset overlaps of
whole texts. Classes are the connected components of the links found. A link of similarity 0.8 is missed by all 32 bands
of 4 registers with a probability of 5e-8.

In a bucket of four members or more two texts may be alike though neither is an end. Such a link matters only where it
would join two classes. So the texts in crowded buckets that hold several classes are joined exactly, those of different
classes with each other. Of the n shingles of a text, a shingle of count w being w of them, those that come
first in one order for all texts, rarest first, are its prefix: n - ceil(0.8 n) + 1 of them, of which alike texts share
one. Texts that share one are compared by length, by place of the shared shingle and by a bitmap of their shingles, all
bounds that no link exceeds, and what is left by exact overlap. The order's counts come from a table of fixed size;
they decide what it costs, not what is found. A shingle in many texts is dealt over cells of at most some CELL * 2 texts.
Texts that share many prefix shingles meet in as many cells; a cell leaves a pair to an earlier one where the shingles right
before the shared one, in the common order, show that the two share one of those too. The join is done twice. First a cell
gives only a forest of the pairs that are alike by the estimate of their bitmaps, as many pairs as it has texts at most:
that makes one class of a large group of near copies, without the pairs inside it. Then, with the classes after those links
were verified, it compares all pairs that no bound rules out. Those never are rows: a cell hands on its texts that have such
a pair, these come with their whole texts, and the cell's task measures the pairs and gives the links that join classes, fewer
than it has texts. As the pairs hold all links between different classes, there is nothing left to repeat.

Results: texts of one to four words have one shingle of all of them; a null or empty text is nothing's duplicate; every
row gives one row, told apart by id and text, so an id with several texts has a class for each; of a class the text with
the least id stays (of one id's several texts, that of the least hash), with all rows that repeat it; rows with a null id
are a class of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from threadlake.llm.components import components, merged
from threadlake.llm.packed import Words, firsts, grams, mix, parts, words_of
from threadlake.llm.storage import durable

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 32, 4, 0.8
#: Texts of one salt that share a prefix shingle, on average at most; a cell has those of two salts.
CELL = 4096
#: Pairs that a task holds before it hands them on.
HELD = 1 << 18
#: Tokens of one salt's texts where texts are compared, on average at most; also those of the pairs compared at once.
TOKENS = 1 << 20
#: Tokens before its own that a row of a cell brings along.
BEFORE = 4
#: Bits of a text's bitmap; counters of the table of shingle counts.
BITS, COUNTERS = 1024, 1 << 20
_EPS = 1e-9
_SEED = np.uint64(0xA24BAED4963EE407)
_SLICE_BYTES = 1 << 20


def bags(words: Words, hashes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), sorted."""
    found = grams(hashes, width)
    row = words.row[: len(found)]
    whole = np.arange(len(found)) + width <= words.first[row + 1]
    row, found = [row[whole]], [found[whole]]
    sizes = words.counts()
    for n in range(1, width):
        short = np.flatnonzero(sizes == n)
        if len(short):
            row.append(short)
            found.append(grams(hashes, n)[words.first[short]])
    row, found = np.concatenate(row), np.concatenate(found)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    head = firsts(row, found)
    return row[head], found[head], np.diff(np.append(head, len(row)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Evenly distributed over (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740992.0


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """For each of n rows the first times of `size` registers; rows without shingles have infinite ones."""
    # The intervals that each count reaches into: [0, 1) and [2^(k - 1), 2^k) for k from 1 on.
    reach = np.ceil(np.log2(count)).astype(np.int64) + 1
    element = np.repeat(np.arange(len(row)), reach)
    k = np.arange(len(element)) - np.repeat(np.cumsum(reach) - reach, reach)
    low = np.where(k > 0, 2.0 ** (k - 1), 0.0)
    rate = np.where(k > 0, low, 1.0)
    key = mix(shingle[element] ^ mix(k.astype(np.uint64) + _SEED))
    owner, weight = row[element], count[element]
    total = np.bincount(row, count, n)
    out = np.full(n * size, np.inf)
    limit = size * (np.log(size) + 4) / np.maximum(total, 1)
    todo = total > 0
    steps = np.arange(1 << 12, dtype=np.uint64) * _SEED
    while todo.any():
        out.reshape(n, size)[todo] = np.inf
        live = np.flatnonzero(todo[owner])
        time, step = np.zeros(len(live)), 0
        while len(live):
            step += 1
            if step == len(steps):
                steps = np.arange(2 * step, dtype=np.uint64) * _SEED
            draw = mix(key[live] + steps[step])
            time = time - np.log(_unit(draw)) / rate[live]
            early = time <= limit[owner[live]]
            live, time, draw = live[early], time[early], mix(draw[early] ^ _SEED)
            inside = np.floor(low[live] + _unit(mix(draw)) * rate[live] * (1 - 1e-12)) < weight[live]
            at = owner[live[inside]] * size + (draw[inside] % np.uint64(size)).astype(np.int64)
            np.minimum.at(out, at, time[inside])
        todo &= np.isinf(out.reshape(n, size)).any(1)
        limit = limit * 2
    return out.reshape(n, size)


def sketches(docs: DataFrame) -> DataFrame:
    """(id, h, key, bands) of docs (id, h, text) with words: a 128-bit key of the word sequence and the hash of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2, _SLICE_BYTES):
                words = words_of(part.column(2))
                hashes = words.hashes()
                full = np.flatnonzero(words.counts())
                if not len(full):
                    continue
                sig = signatures(*bags(words, hashes), part.num_rows)[full].view(np.uint64)
                band = np.full((len(full), BANDS), 1, np.uint64)
                for r in range(ROWS):
                    band = mix(band * _SEED + sig[:, r::ROWS])
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * _SEED)
                key = np.empty((len(full), 2), np.uint64)
                length = np.diff(words.first)[full]
                place = np.arange(len(hashes)) - np.repeat(words.first[full], length)
                for j, base in enumerate((_SEED, np.uint64(0x9E3779B97F4A7C15))):
                    powers = np.cumprod(np.full(int(length.max()), base, np.uint64))
                    key[:, j] = mix(np.add.reduceat(mix(hashes + np.uint64(j)) * powers[place], words.first[full]) + length.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(full)), part.column(1).take(pa.array(full)), pa.array([x.tobytes() for x in key], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(band.reshape(-1).view(np.int64)), BANDS).cast(pa.list_(pa.int64()))],
                    ["id", "h", "key", "bands"],
                )

    return docs.select("id", "h", "text").mapInArrow(run, "id long, h long, key binary, bands array<long>")


def buckets(texts: DataFrame) -> DataFrame:
    """(id, doc, band, bucket) of texts (id, doc, bands)."""
    return texts.select("id", "doc", F.posexplode("bands").alias("band", "bucket"))


def candidates(spread: DataFrame) -> DataFrame:
    """(id, hub) of buckets: pairs to compare, each text with the ends of its buckets, by documents' ids: what others were
    made from tends to come first, and is like all of them."""
    place = F.struct("doc", "id")
    hubs = spread.groupBy("bucket").agg(F.min(place)["id"].alias("least"), F.max(place)["id"].alias("most")).filter("least <> most")
    met = spread.join(hubs, "bucket").select("id", F.explode(F.array("least", "most")).alias("hub")).filter("id <> hub")
    return met.select(F.greatest("id", "hub").alias("id"), F.least("id", "hub").alias("hub")).distinct()


def crowded(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, component) of the texts (id, doc, bands) in buckets of four members or more and of several classes by labels
    (node, component): in smaller buckets the ends meet all others, so nothing is left to compare. Classes are joined to
    texts, before those are spread over their buckets."""
    known = texts.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.explode("bands").alias("bucket"))
    several = known.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("n > 3 AND low <> high").select("bucket")
    return known.join(several, "bucket", "left_semi").select("id", "component").distinct()


def drawn(spread: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """(id, hub): each text of a bucket of several classes with one member, drawn anew in each turn, of one of its buckets,
    if that is of another class. One pair a text, so a large group costs its size and not its square."""
    known = spread.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    hubs = known.groupBy("bucket").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(turn))).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    met = known.join(hubs.select("bucket", F.col("hub.id").alias("hub"), F.col("hub.component").alias("far")), "bucket").filter("component <> far")
    own = met.groupBy("id").agg(F.min_by("hub", F.xxhash64("id", "bucket", F.lit(turn))).alias("hub"))
    return own.select(F.greatest("id", "hub").alias("id"), F.least("id", "hub").alias("hub")).distinct()


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, token): each shingle of count w as w different tokens, sorted by row."""
    words = words_of(texts)
    row, shingle, count = bags(words, words.hashes())
    upto = np.cumsum(count)
    nth = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - count, count)
    return np.repeat(row, count), mix(np.repeat(shingle, count) + nth.astype(np.uint64) * _SEED)


def _counter(token: np.ndarray) -> np.ndarray:
    return (token % np.uint64(COUNTERS)).astype(np.int64)


def _token_counts(texts: DataFrame) -> np.ndarray:
    """How many texts (id, component, text) have a token, by counter; a table of COUNTERS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in parts(batch, 2):
                total += np.bincount(_counter(_tokens(part.column(2))[1]), minlength=COUNTERS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["counter", "n"])

    found = texts.mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """(id, component, size, bits, tokens) of texts (id, component, text): the number of tokens, their bitmap and, of the
    tokens in the common order, the prefix that a text of this similarity shares one of."""
    shared = texts.sparkSession.sparkContext.broadcast(_token_counts(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                row, token = _tokens(part.column(2))
                size = np.bincount(row, minlength=part.num_rows)
                bit = (mix(token ^ _SEED) % np.uint64(BITS)).astype(np.int64)
                odd = np.zeros(part.num_rows * BITS, np.uint8)
                np.bitwise_xor.at(odd, row * BITS + bit, 1)
                bits = np.packbits(odd.reshape(-1, BITS), axis=1)
                order = np.lexsort((token, shared.value[_counter(token)], row))
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                length = np.where(size > 0, size - np.ceil(similarity * size - _EPS).astype(np.int64) + 1, 0)
                kept = token[order][place < length[row]].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(length, size))]), pa.int32()), pa.array(kept))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), pa.array([x.tobytes() for x in bits], pa.binary()), lists], ["id", "component", "size", "bits", "tokens"])

    return texts.mapInArrow(run, "id long, component long, size long, bits binary, tokens array<long>")


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of classes (a, b) join two, one after the other; and each class's root after that."""

    def root(x: int) -> int:
        while of[x] != x:
            of[x] = x = of[of[x]]
        return x

    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    of, joins = list(range(len(names))), np.zeros(len(a), bool)
    for k, (x, y) in enumerate(at.reshape(2, -1).T.tolist()):
        x, y = root(x), root(y)
        if x != y:
            of[max(x, y)], joins[k] = min(x, y), True
    parent = parent.copy()
    parent[names] = names[[root(x) for x in range(len(names))]]
    return joins, parent[parent]


def _alike(rows: pa.Table, similarity: float, forest: bool = False, measured: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of whole cells, sorted by cell and size, that no bound rules out, by their places in the table. A pair
    of which it shows that an earlier cell has it too is left to that. With `forest` only pairs whose bitmaps differ in no
    more bits than alike texts' do on average, and of these only what joins a cell's classes; with `measured`, which gives
    the similarities of pairs, only pairs that are alike, and of these too only what joins a cell's classes."""
    token, low, high, size, _, component, salt, place = (rows.column(k).to_numpy() for k in range(8))
    begin = firsts(token, low, high)
    cell = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(token))))
    one, place = low == high, place.astype(np.int64)
    bits = np.frombuffer(b"".join(rows.column(8).to_pylist()), np.uint64).reshape(-1, BITS // 64)
    flat = pc.list_flatten(rows.column(9))
    before, is_there = (x.to_numpy().reshape(rows.num_rows, -1) for x in (pc.fill_null(flat, 0), pc.is_valid(flat)))
    # A class in a cell is known by its first row there.
    order = np.lexsort((component, cell))
    head = firsts(cell[order], component[order])
    group = np.empty(len(cell), np.int64)
    group[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(cell))))
    i, step = np.arange(len(cell)), 0
    while len(i):
        step += 1
        i = i[i + step < len(cell)]
        j = i + step
        i = i[(cell[i] == cell[j]) & (size[i] >= similarity * size[j] - _EPS)]
        j = i + step
        worth = (group[i] != group[j]) & (one[i] | (salt[i] != salt[j]))
        a, b = i[worth], j[worth]
        least = np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - _EPS)
        near = np.minimum(place[a], place[b]) + np.minimum(size[a] - place[a], size[b] - place[b]) >= least
        a, b = a[near], b[near]
        most = size[a] + size[b] - 2 * least[near]
        if forest:
            most = BITS / 2 * (1 - np.exp(-2 * most / BITS))
        near = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= most
        a, b = a[near], b[near]
        new = np.ones(len(a), bool)
        for x in range(before.shape[1]):
            for y in range(before.shape[1]):
                new &= (before[a, x] != before[b, y]) | ~is_there[a, x] | ~is_there[b, y]
        if measured:
            a, b = a[new], b[new]
            near = measured(a, b) >= similarity
            a, b, new = a[near], b[near], np.ones(np.count_nonzero(near), bool)
        if (forest or measured) and len(a):
            joins, parent = _roots(np.arange(len(head)), group[a], group[b])
            new, group = new & joins, parent[group]
        if new.any():
            yield a[new], b[new]


def _with_texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes (id, ..) with their texts, from docs (id, text); or nodes (id, doc, h, ..) from docs (doc, h, text). Always by
    shuffle: nodes grow with the documents, so a broadcast would only hide the cost at small sizes."""
    on = ["doc", "h"] if "doc" in nodes.columns else ["id"]
    return docs.join(nodes.hint("shuffle_merge"), on).dropDuplicates(["id"])


def bridges(crowd: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """(id, hub) of crowd (id, component): the pairs of texts of different components that may be alike."""
    texts = _with_texts(crowd, docs).select("id", "component", "text")
    return _bridges(durable(_prefixes(durable(texts, "crowded-texts"), similarity), "prefixes"), similarity, cell)


def _placed(known: DataFrame, cell: int) -> DataFrame:
    """(token, size, id, component, place, bits, before, salts) of known (id, component, size, bits, tokens): each text once for
    each token of its prefix that several components have, with its place there and the BEFORE tokens before it."""
    before = F.array(*(F.get("tokens", F.col("place") - k) for k in range(1, BEFORE + 1)))
    spread = known.select("id", "component", "tokens", F.posexplode("tokens").alias("place", "token")).select("id", "component", "place", "token", before.alias("before"))
    groups = spread.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    groups = groups.filter("low <> high").select("token", F.ceil(F.col("n") / cell).cast("int").alias("salts"))
    return spread.join(groups, "token").join(known.select("id", "size", "bits"), "id")


def _cells(placed: DataFrame, *more: str) -> DataFrame:
    """The rows of placed once for each cell of their token, those of a cell together, sorted by size: the texts of a token
    have `salts` salts, and a cell (low, high) has those of two or one of them."""
    met = placed.withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    met = met.select("token", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"), "size", "id", "component", "salt", "place", "bits", "before", *more)
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "token", "low", "high").sortWithinPartitions("token", "low", "high", "size", "id")


def _by_cells(met: DataFrame, made: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """What `made` gives for tables of whole cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows if rest is None else pa.concat_tables([rest, rows])
                last = int(firsts(*(rows.column(k).to_numpy() for k in range(3)))[-1])
                if last:
                    yield from made(rows.slice(0, last))
                rest = rows.slice(last)
        if rest is not None:
            yield from made(rest)

    return met.mapInArrow(run, schema)


def _pairs(known: DataFrame, similarity: float, cell: int, forest: bool) -> DataFrame:
    """(id, hub) as in `_bridges`, but a pair may come from several cells."""

    def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, found, held = rows.column("id").to_numpy(), [], 0

        def told() -> pa.RecordBatch:
            pairs = np.unique(np.sort(np.concatenate(found, 1), 0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[1], pa.int64()), pa.array(pairs[0], pa.int64())], ["id", "hub"])

        for a, b in _alike(rows, similarity, forest):
            found.append(np.stack([ids[a], ids[b]]))
            held += len(a)
            if held >= HELD:
                yield told()
                found, held = [], 0
        if found:
            yield told()

    return _by_cells(_cells(_placed(known, cell)), made, "id long, hub long")


def _bridges(known: DataFrame, similarity: float = SIMILARITY, cell: int = CELL, forest: bool = False) -> DataFrame:
    """(id, hub) of known (id, component, size, bits, tokens): the pairs of different components that may be alike; with
    `forest` not all of them, but in each cell as many as it has texts at most."""
    return _pairs(known, similarity, cell, forest).distinct()


def _measured(texts: pa.ChunkedArray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the similarities of the texts at places a and b."""
    tokens = []
    for batch in pa.table([texts], ["text"]).to_batches():
        for part in parts(batch, 0):
            row, token = _tokens(part.column(0))
            tokens.append((np.bincount(row, minlength=part.num_rows), token))
    size = np.concatenate([n for n, _ in tokens])
    first = np.cumsum(size) - size
    names, name = np.unique(np.concatenate([t for _, t in tokens]), return_inverse=True)

    def measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared, upto, at = np.zeros(len(a), np.int64), np.cumsum(size[a] + size[b]), 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOKENS, "right")))
            own = np.concatenate([a[at:to], b[at:to]])
            n = size[own]
            place = np.arange(n.sum()) + np.repeat(first[own] - (np.cumsum(n) - n), n)
            # A token is in a text once, so one that is found twice for a pair is in both.
            met = np.sort(np.repeat(np.tile(np.arange(to - at), 2), n) * len(names) + name[place])
            shared[at:to] = np.bincount(met[1:][met[1:] == met[:-1]] // max(len(names), 1), minlength=to - at)
            at = to
        return shared / np.maximum(size[a] + size[b] - shared, 1)

    return measured


def _joins(known: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, cell: int = CELL, tokens: int = TOKENS) -> DataFrame:
    """(id, hub, similarity) of known (id, component, size, bits, tokens) and texts (id, text): links between different
    components, in each cell what joins its classes, so all together join what all links do. Pairs stay inside the tasks:
    first a cell hands on those of its texts that have a pair there which no bound rules out, each once, then these come
    with their texts, are compared there and give links, fewer than they are."""
    met = _cells(_placed(known, cell))

    def members(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        some = np.zeros(rows.num_rows, bool)
        for a, b in _alike(rows, similarity):
            some[a] = some[b] = True
        yield from rows.filter(pa.array(some)).to_batches()

    def joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, measured = rows.column("id").to_numpy(), _measured(rows.column("text"))
        found = [(np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]), measured(a, b)) for a, b in _alike(rows, similarity, measured=measured)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["id", "hub", "similarity"])

    some = durable(_by_cells(met, members, met.schema).drop("low", "high", "salt").dropDuplicates(["token", "id"]), "compared")
    groups = some.groupBy("token").agg(F.ceil(F.greatest(F.count("*") / cell, F.sum("size") / tokens)).cast("int").alias("salts"))
    own = some.join(groups, "token").join(texts.hint("shuffle_merge"), "id")
    return _by_cells(_cells(own, "text"), joined, "id long, hub long, similarity double").dropDuplicates(["id", "hub"])


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The weighted Jaccard similarity of the shingles of each pair of texts."""
    bag = []
    for texts in (left, right):
        words = words_of(texts)
        bag.append(bags(words, words.hashes()))
    row, shingle, count = (np.concatenate(x) for x in zip(*bag))
    order = np.lexsort((shingle, row))
    row, shingle, count = row[order], shingle[order], count[order]
    head = firsts(row, shingle)
    size = np.diff(np.append(head, len(row)))
    both = np.where(size == 2, np.minimum(count[head], count[np.minimum(head + 1, len(count) - 1)]), 0)
    shared = np.bincount(row[head], both, len(left))
    return shared / np.maximum(np.bincount(row, count, len(left)) - shared, 1)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, hub, similarity) of pairs (id, hub) of nodes (id, doc, h)."""
    members = pairs.select("id").union(pairs.select(F.col("hub").alias("id"))).distinct()
    texts = durable(_with_texts(nodes.join(members, "id", "left_semi"), docs).select("id", "text"), "near-texts")
    sides = pairs.join(texts, "id").join(texts.select(F.col("id").alias("hub"), F.col("text").alias("hub_text")), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(similarities(part.column(2), part.column(3)))], ["id", "hub", "similarity"])

    return sides.select("id", "hub", "text", "hub_text").mapInArrow(run, "id long, hub long, similarity double")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, text): a row's id, a hash that tells the texts of one id apart, and its text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def links(rows: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of rows (doc, h, text): (doc, h, id): for each with an id and words the number of its word sequence; (id, doc, h): the
    least row of each; (a, b, similarity): links between those, enough to hold every class together; and (node,
    component): their classes."""
    rows = rows.filter("doc IS NOT NULL")
    known = durable(sketches(rows.withColumnRenamed("doc", "id")).withColumnRenamed("id", "doc"), "sketches")
    firsts_of = known.groupBy("key").agg(F.min(F.struct("doc", "h")).alias("first"), F.first("bands").alias("bands"))
    firsts_of = durable(firsts_of.select(F.monotonically_increasing_id().alias("id"), "key", "first.doc", "first.h", "bands"), "texts")
    members = known.select("doc", "h", "key").distinct().join(firsts_of.select("key", "id"), "key").select("doc", "h", "id")
    nodes, texts = firsts_of.select("id", "doc", "h"), firsts_of.select("id", "doc", "bands")

    def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
        alike = _verified(durable(pairs, "pairs"), nodes, docs).filter(F.col("similarity") >= similarity)
        return durable(alike.select(F.col("id").alias("a"), F.col("hub").alias("b"), "similarity"), "near-links")

    found = verified(candidates(buckets(texts)), nodes, rows)
    labels = components(found)
    crowd = durable(crowded(texts, labels).join(nodes, "id"), "crowded")
    if crowd.isEmpty():
        return members, nodes, found, labels
    own = durable(_with_texts(crowd, rows).select("id", "component", "text"), "crowded-texts")
    known = durable(_prefixes(own, similarity), "prefixes")
    likely = verified(_bridges(known, similarity, forest=True), own.select("id"), own.select("id", "text"))
    if not likely.isEmpty():
        found, labels = found.union(likely), merged(labels, likely)
        known = durable(known.drop("component").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "prefixes")
    more = durable(_joins(known, own.select("id", "text"), similarity).select(F.col("id").alias("a"), F.col("hub").alias("b"), "similarity"), "near-links")
    if not more.isEmpty():
        found, labels = found.union(more), merged(labels, more)
    return members, nodes, found, labels


def _classes(rows: DataFrame, similarity: float) -> DataFrame:
    """(doc, h, class_id, n_links, kept) of rows with an id and words, once for each id and text."""
    members, nodes, found, labels = links(rows, similarity)
    degree = found.select("a").union(found.select("b")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_links"))
    own = nodes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = own.groupBy("component").agg(F.min(F.struct("doc", "h")).alias("least"))
    of = own.join(least, "component").join(degree, "id", "left").select("id", F.col("least.doc").alias("class_id"), F.col("least.h").alias("_h"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    kept = (F.col("doc") == F.col("class_id")) & (F.col("h") == F.col("_h"))
    return members.join(of, "id").select("doc", "h", "class_id", "n_links", kept.alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, kept) of each document: the least id of its class, the number of links found between its
    text and other texts, and whether it is the one of its class that stays."""
    rows = _rows(docs, id_col, text_col)
    met = rows.select("doc", "h").join(_classes(rows, similarity), ["doc", "h"], "left")
    return met.select(F.col("doc").alias(id_col), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("kept", F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of each class but those of the text that stays."""
    gone = _classes(_rows(docs, id_col, text_col), similarity).filter("NOT kept").select(F.col("doc").alias("_doc"), F.col("h").alias("_h"))
    same = (docs[id_col].cast("long") == gone["_doc"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["_h"])
    return docs.join(gone, same, "left_anti")
