"""Hard negatives by exact inner-product search over one-dimensional distance keys.

1. Each vector x gets one more component, sqrt(M - x.x), M being the greatest x.x, so that all have the same length. For
   an anchor q with a zero there, distance ** 2 = q.q + M - 2 * (inner product): the nearest are those of the best score.
2. Pivots are fitted on a bounded sample (SAMPLE rows; it decides what the search costs, not what it finds). Each vector
   belongs to its nearest pivot, and its key is (pivot, distance to it). Vectors are stored in the order of their keys;
   an interval of RINGS keys of a pivot is a cell. A table of all cells' bounds has a fixed size.
3. For an anchor at distance d of a pivot, a vector of key r is at least |d - r| and at most d + r away. So a cell, an
   annulus, has a greatest and a least possible score. A search visits cells in the order of the greatest one, in rounds of
   ever more cells: the key intervals around the anchor's own grow. A cell whose greatest score is below the k-th best
   found, or that lies outside of the scores asked for, is never read; what is left at the end is certified by that bound.
4. In a round anchors go to the cells they visit, in blocks of a bounded number, and rows of a cell pass by them, so that
   a task holds one block and a slice of rows. Cells of many equal vectors are dealt over tasks.

Scores are inner products of whole numbers, exact. The rows of a cell that a round reads hand on only what is among the
slice's k best of an anchor and not worse than its k-th best so far.

Results: rows with a null id, a null label, a null vector or a null or non-finite component take no part; components of
more than 2 ** 24 after scaling count as 2 ** 24; a shorter vector is one with zeros at its end; rows with the anchor's own
id are never its positives; repeated rows count each time, and of a repeated anchor each has its results; ties go to the
smaller id; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.llm.packed import firsts, gathered
from threadlake.llm.storage import durable, partitions

PIVOTS, RINGS, SAMPLE = 16, 8, 2048
#: Cells that are visited after each round, in the order of their greatest scores.
ROUNDS = (8, 32, PIVOTS * RINGS)
#: Anchors of a block; rows of a cell that one task reads; rows that are compared at once.
BLOCK, CELL_ROWS, SLICE = 16_384, 1 << 18, 2048
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
_MOST = 1 << 24


class Index(NamedTuple):
    items: DataFrame  # (cell, sub, id, label, v), in the order of (cell, distance)
    pivots: np.ndarray
    low: np.ndarray  # of each cell, its least and greatest distance to its pivot; infinite if empty
    high: np.ndarray
    longest: int  # the greatest x.x
    dims: int
    largest: int  # the greatest component
    subs: np.ndarray  # parts of each cell


def whole_vectors(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, v) of rows that take part: components scaled, then rounded down."""
    x = lambda c: c.cast("double")
    odd = F.exists(vector_col, lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd)
    number = lambda c: F.floor(F.greatest(F.least(x(c) * scale, F.lit(float(_MOST))), F.lit(float(-_MOST)))).cast("int")
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(vector_col, number).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, with zeros where they end early."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dims), np.int64)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _lengthened(x: np.ndarray, longest: int) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T), 0))


def _fitted(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivots, each the farthest from those before, moved to the middle of what is nearest to them; and for each the
    distances between its rings."""
    chosen, far = [0], None
    for _ in range(min(PIVOTS, len(sample)) - 1):
        d = _distances(sample, sample[chosen[-1:]])[:, 0]
        far = d if far is None else np.minimum(far, d)
        chosen.append(int(far.argmax()))
    pivots = sample[chosen]
    for _ in range(5):
        own = _distances(sample, pivots).argmin(1)
        pivots = np.stack([sample[own == p].mean(0) if (own == p).any() else pivots[p] for p in range(len(pivots))])
    d = _distances(sample, pivots)
    own, cuts = d.argmin(1), np.zeros((len(pivots), RINGS - 1))
    for p in range(len(pivots)):
        near = d[own == p, p]
        cuts[p] = np.quantile(near, np.arange(1, RINGS) / RINGS) if len(near) else 0
    return pivots, cuts


def indexed(items: DataFrame) -> Index | None:
    """The index of items (id, label, v), or None without rows."""
    length = F.aggregate("v", F.lit(0).cast("double"), lambda a, c: a + c.cast("double") * c)
    stats = items.agg(F.max(length).alias("longest"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    if stats.dims is None:
        return None
    dims, longest = max(stats.dims, 1), int(stats.longest)
    sample = items.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").toArrow()
    pivots, cuts = _fitted(_lengthened(_matrix(sample.column("v"), dims), longest))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, SLICE):
            d = _distances(_lengthened(_matrix(table.column("v"), dims), longest), pivots)
            pivot = d.argmin(1)
            d = d[np.arange(len(d)), pivot]
            cell = pivot * RINGS + (d[:, None] > cuts[pivot]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d), *(table.column(c).combine_chunks() for c in ("id", "label", "v"))], ["cell", "distance", "id", "label", "v"])

    n = partitions(items)
    dealt = items.mapInArrow(keyed, "cell int, distance double, id long, label long, v array<int>").repartitionByRange(n, "cell", "distance", "id").sortWithinPartitions("cell", "distance", "id")
    stored = durable(dealt, "distance-keys")
    cells = PIVOTS * RINGS
    low, high, subs = np.full(cells, np.inf), np.full(cells, -np.inf), np.ones(cells, np.int64)
    for row in stored.groupBy("cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).collect():  # one row a cell
        low[row.cell], high[row.cell], subs[row.cell] = row.low, row.high, -(-row.n // CELL_ROWS)
    parts_of = F.element_at(F.array(*map(F.lit, subs.tolist())), F.col("cell") + 1)
    return Index(stored.withColumn("sub", F.pmod(F.xxhash64("id"), parts_of).cast("int")), pivots, low, high, longest, dims, stats.largest or 0, subs)


def _visits(index: Index, queries: DataFrame, begin: int, end: int) -> DataFrame:
    """(cell, sub, and queries' columns): the cells at places begin to end of each query's order that may hold something."""
    pivots, low, high, longest, dims, subs = index.pivots, index.low, index.high, index.longest, index.dims, index.subs
    names = ["q", "own", "label", "v", "least", "most", "kth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 256):
            for s in range(0, table.num_rows, 256):
                rows = table.slice(s, 256).combine_chunks()
                x = _matrix(rows.column("v"), dims)
                square = (x.astype(np.float64) ** 2).sum(1)[:, None]
                d = _distances(np.column_stack([x.astype(np.float64), np.zeros(len(x))]), pivots)
                d = np.repeat(d, RINGS, axis=1)
                d = np.pad(d, ((0, 0), (0, len(low) - d.shape[1])))
                slack = 1e-9 * (square + longest) + 1e-3
                nearest = np.maximum(np.maximum(low - d, d - high), 0)
                nearest[:, np.isinf(low)] = np.inf
                best, worst = (square + longest - nearest**2) / 2 + slack, (square + longest - (d + np.maximum(high, 0)) ** 2) / 2 - slack
                least, most, kth = (rows.column(c).to_numpy()[:, None] for c in ("least", "most", "kth"))
                cap = np.minimum(best, most)
                order = np.lexsort((np.abs((best + worst) / 2 - cap), -cap))[:, begin:end]
                row = np.repeat(np.arange(len(x)), order.shape[1])
                cell = order.reshape(-1)
                may = (best[row, cell] >= np.maximum(least, kth)[row, 0]) & (worst[row, cell] <= most[row, 0]) & (least <= most)[row, 0]
                row, cell = row[may], cell[may]
                times = subs[cell]
                sub = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(sub.astype(np.int32)), *(rows.column(c).combine_chunks().take(pa.array(row)) for c in names)], ["cell", "sub", *names])

    return queries.select(*names).mapInArrow(run, "cell int, sub int, q long, own long, label long, v array<int>, least long, most long, kth long")


def _scored(index: Index, visits: DataFrame, n_queries: int, k: int, same: bool) -> DataFrame:
    """(q, id, score): for the queries of visits the best rows of the cells they visit."""
    n_blocks, dims = max(1, -(-n_queries // BLOCK)), index.dims
    exact_floats = dims * max(index.largest, 1) ** 2 < 1 << 53
    none = F.lit(None).cast("long")
    asked = visits.select("cell", "sub", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("q").alias("id"), "own", "label", "v", "least", "most", "kth")
    held = index.items.select("cell", "sub", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", none.alias("own"), "label", "v", *(none.alias(c) for c in ("least", "most", "kth")))
    key = ["cell", "sub", "block"]
    met = asked.unionByName(held).repartition(partitions(visits), *key).sortWithinPartitions(*key, "kind")

    def best(queries: pa.Table, rows: pa.Table) -> pa.RecordBatch:
        x, y = _matrix(rows.column("v"), dims), _matrix(queries.column("v"), dims)
        score = (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64) if exact_floats else x @ y.T
        q, own, label, least, most, kth = (queries.column(c).to_numpy() for c in ("id", "own", "label", "least", "most", "kth"))
        ids, of = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        good = (of[:, None] == label) == same
        good &= (score >= np.maximum(least, kth)) & (score <= most) & (ids[:, None] != own)
        lowest = np.iinfo(np.int64).min
        score = np.where(good, score, lowest)
        if len(ids) > k:
            good &= score >= np.partition(score, len(ids) - k, axis=0)[len(ids) - k]
        row, column = np.nonzero(good)
        order = np.lexsort((ids[row], -score[row, column], column))
        row, column = row[order], column[order]
        start = firsts(column)
        place = np.arange(len(column)) - np.repeat(start, np.diff(np.append(start, len(column))))
        row, column = row[place < k], column[place < k]
        return pa.RecordBatch.from_arrays([pa.array(q[column]), pa.array(ids[row]), pa.array(score[row, column])], ["q", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, waiting = None, [], []

        def passed() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if queries and waiting:
                asking, rows = pa.concat_tables(queries).combine_chunks(), pa.concat_tables(waiting).combine_chunks()
                wide = max(1, (1 << 22) // max(rows.num_rows, 1))
                for s in range(0, asking.num_rows, wide):
                    yield best(asking.slice(s, wide), rows)
            waiting = []

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            columns = [table.column(c).to_numpy() for c in (*key, "kind")]
            begin = firsts(*columns)
            for b, e in zip(begin.tolist(), np.append(begin, table.num_rows)[1:].tolist()):
                group, kind = tuple(int(c[b]) for c in columns[:3]), columns[3][b]
                if group != at:
                    yield from passed()
                    at, queries = group, []
                if kind == 0:
                    queries.append(table.slice(b, e - b))
                    continue
                for s in range(b, e if queries else b, SLICE):
                    waiting.append(table.slice(s, min(SLICE, e - s)))
                    if sum(w.num_rows for w in waiting) >= SLICE:
                        yield from passed()
        yield from passed()

    return met.mapInArrow(run, "q long, id long, score long")


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(q, id, score, place): for each query (q, own, label, v, least, most) the k best rows of its label, or of all others,
    with scores from least to most and an id that is not its own."""
    n_queries = queries.count()
    lowest, best = F.lit(np.iinfo(np.int64).min), None
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    for begin, end in zip((0, *ROUNDS), ROUNDS):
        state = queries.withColumn("kth", lowest)
        if best is not None:
            kth = best.filter(F.col("place") == k).select("q", F.col("score").alias("found"))
            state = queries.join(kth, "q", "left").withColumn("kth", F.coalesce("found", lowest))
        visits = durable(_visits(index, state, begin, end), "visits")
        if best is not None and visits.isEmpty():
            break
        found = _scored(index, visits, n_queries, k, same)
        found = found if best is None else found.unionByName(best.drop("place"))
        best = durable(found.withColumn("place", place).filter(F.col("place") <= k), "best")
    return best


def mined(items: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of items (id, label, v) that
    are anchors: of each of its best rows of the same label, the best rows of other labels whose score is between the two
    shares, in hundredths, of that one's."""
    spark, items = items.sparkSession, durable(items, "vectors")
    index = indexed(items)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = [F.lit(np.iinfo(np.int64).min).alias("least"), F.lit(np.iinfo(np.int64).max).alias("most")]
    asking = durable(items.filter(anchors).select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("own"), "label", "v", *whole), "anchors")
    near = search(index, asking, positives, True).select("q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    low, high = share
    floored = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100")
    pairs = near.join(asking.select("q", "own", "label", "v"), "q").withColumn("least", -floored(f"positive_score * -{low}")).withColumn("most", floored(f"positive_score * {high}"))
    pairs = durable(pairs.withColumn("q", F.monotonically_increasing_id()), "pairs")
    hard = search(index, pairs.select("q", "own", "label", "v", "least", "most"), negatives, False)
    out = hard.select("q", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank")).join(pairs, "q")
    return out.select(F.col("own").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
