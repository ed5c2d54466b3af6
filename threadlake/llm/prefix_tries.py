"""The trie of all conversations' prefixes, from tries that partitions build of their own rows and that are merged.

A conversation is rebuilt as the first h turns of the conversation that leads its block of BLOCK ids, then its own turns
after its first h, h being the CRC-32 of its id modulo HEADS. Each different sequence of first turns is a node.

1. Turns, known by 128 bits of role and text and by their length, are dealt by ranges of (conversation, turn), so that
   a conversation of any length lies in as many partitions as it needs, and blocks lie together. A scan gives each turn
   its place and a polynomial over the turns up to it. What a partition must know of those before it are two rows of
   each (`_carries`) and the first turns of two conversations at most; nothing else passes through the driver.
2. A second scan writes the path of each rebuilt conversation: a row for each of its nodes.
3. Partitions combine paths into node tables (members, least member, members that end there); tables are merged by node
   key in rounds of FAN tables to one, so that a node that all partitions have is added up by many tasks. The ids that
   end at a node stay in runs, which are disjoint ranges and so are merged by putting them in order.
4. Rollup from below, in a constant number of shuffles: the least member of a node owns it. What a conversation owns is
   the lower end of its path. So each conversation hands its sum to the nodes above it on its path, and sums within its
   own chain are running ones. A hot node gets partial sums of tasks, never a group of rows.

Results: turns of one number are put in order by a hash of role and text; repeated rows are repeated turns; rows with a
null conv_id belong to no conversation; null texts and roles are empty; the remainder of a negative id is taken upwards,
so that its block's least id leads; other columns are not read; an empty table gives no nodes, not even a root. Two
sequences count as one if 128 bits agree. The list of ids that end at one node is hashed in order by one task, a
constant amount of it at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from threadlake.llm.joins import joined
from threadlake.llm.packed import firsts, gathered
from threadlake.llm.storage import durable, forget, partitions

BLOCK, HEADS = 100, 6
#: Node tables that one round merges into one; ids of a run; depths of a block of running sums.
FAN, RUN, DEPTHS = 64, 4096, 4096
#: Nodes that have more than one in HOT of all nodes as children are HOT at most.
HOT = 1024
_ROWS = 1 << 15
_STEP = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_BACK = np.array([pow(int(x), -1, 1 << 64) for x in _STEP], np.uint64)
_KEY = ["depth", "k1", "k2"]


def _powers(of: np.ndarray, upto: np.ndarray) -> np.ndarray:
    out, of, left = np.ones((len(upto), 2), np.uint64), of.copy(), upto.astype(np.int64)
    while left.any():
        out[(left & 1) == 1] *= of
        of, left = of * of, left >> 1
    return out


def _lanes(rows: pa.Table, *names: str) -> np.ndarray:
    return np.stack([rows.column(n).to_numpy() for n in names], 1).view(np.uint64)


def turns(conversations: DataFrame, n: int) -> DataFrame:
    """(part, conv_id, h, i, x1, x2, p1, p2, chars): each turn with its place i and polynomial p in what its partition, a
    range of conversations and turns, has of its conversation."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        (F.crc32(F.col("conv_id").cast("long").cast("string")) % HEADS).cast("int").alias("h"),
        *[F.xxhash64(F.lit(lane), role, text).alias(f"x{lane}") for lane in (1, 2)],
        F.char_length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", "turn", "x1", "x2"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "h", "x1", "x2", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_conv, open_i, open_p = TaskContext.get().partitionId(), None, 0, np.zeros(2, np.uint64)
        for table in gathered(batches, _ROWS):
            conv, x = table.column("conv_id").to_numpy(), _lanes(table, "x1", "x2")
            start, at = firsts(conv), np.arange(len(conv))
            own = np.repeat(start, np.diff(np.append(start, len(conv))))
            total = np.cumsum(x * _powers(_BACK, at), axis=0)
            p = (total - np.where(own[:, None] > 0, total[own - 1], np.uint64(0))) * _powers(_STEP, at)
            i = at - own + 1
            if conv[0] == open_conv:
                more = own == 0
                p[more] += open_p * _powers(_STEP, i[more])
                i[more] += open_i
            open_conv, open_i, open_p = conv[-1], i[-1], p[-1]
            p = p.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(conv), part, np.int32)), *(table.column(c).combine_chunks() for c in ("conv_id", "h")), pa.array(i), *(table.column(c).combine_chunks() for c in ("x1", "x2")), pa.array(p[:, 0]), pa.array(p[:, 1]), table.column("chars").combine_chunks()],
                ["part", "conv_id", "h", "i", "x1", "x2", "p1", "p2", "chars"],
            )

    return dealt.mapInArrow(run, "part int, conv_id long, h int, i long, x1 long, x2 long, p1 long, p2 long, chars long")


class _Carries(NamedTuple):
    before: dict[int, tuple[int, int, np.ndarray]]  # by part: the conversation it goes on with, its turns before, their polynomial
    after: dict[int, int]  # by part: the conversation that goes on in the next
    first: dict[int, int]  # by part: its first conversation
    heads: dict[int, tuple[np.ndarray, np.ndarray]]  # by conversation: polynomials and lengths of its first turns, HEADS at most


def _base(conv: np.ndarray | int) -> np.ndarray | int:
    return conv - conv % BLOCK


def _carries(local: DataFrame) -> _Carries:
    """What partitions must know of others: two rows of each part, and the first turns of two conversations for each."""
    spark, last = local.sparkSession, F.struct("conv_id", "i", "p1", "p2")
    ends = local.groupBy("part").agg(F.max_by(last, F.struct(F.expr("~conv_id"), "i")).alias("low"), F.max_by(last, F.struct("conv_id", "i")).alias("high"))
    before, after, first, known = {}, {}, {}, None
    lane = lambda row: np.array([row.p1, row.p2], np.int64).view(np.uint64)
    for row in sorted(ends.collect()):
        first[row.part] = row.low.conv_id
        upto, p = row.low.i, lane(row.low)
        if known and known[1] == row.low.conv_id:
            before[row.part], after[known[0]] = known[1:], known[1]
            p, upto = known[3] * _powers(_STEP, np.array([upto]))[0] + p, known[2] + upto
        known = (row.part, row.low.conv_id, upto, p) if row.low.conv_id == row.high.conv_id else (row.part, row.high.conv_id, row.high.i, lane(row.high))
    wanted = sorted({c for f in first.values() for c in (f, _base(f))})
    found: dict[int, dict[int, tuple[np.ndarray, int]]] = {}
    if wanted:
        ids = F.broadcast(spark.createDataFrame([(c,) for c in wanted], "conv_id long"))
        for row in local.filter(F.col("i") <= HEADS).join(ids, "conv_id").select("part", "conv_id", "i", "p1", "p2", "chars").collect():
            conv, upto, p = before.get(row.part, (None, 0, None))
            i, own = (row.i + upto, p * _powers(_STEP, np.array([row.i]))[0] + lane(row)) if conv == row.conv_id else (row.i, lane(row))
            if i <= HEADS:
                found.setdefault(row.conv_id, {})[i] = (own, row.chars)
    heads = {c: (np.stack([np.zeros(2, np.uint64), *(x[i][0] for i in sorted(x))]), np.array([0, *(x[i][1] for i in sorted(x))])) for c, x in found.items()}
    return _Carries(before, after, first, heads)


class _Leads:
    """The first turns of the conversations that lead a block, and of those that go on from an earlier partition."""

    def __init__(self, known: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.ids = np.array(sorted(known), np.int64)
        self.n = np.array([len(known[c][1]) - 1 for c in self.ids.tolist()], np.int64)
        self.p, self.chars = np.zeros((len(self.ids), HEADS + 1, 2), np.uint64), np.zeros((len(self.ids), HEADS + 1), np.int64)
        for k, c in enumerate(self.ids.tolist()):
            self.p[k, : self.n[k] + 1], self.chars[k, : self.n[k] + 1] = known[c]

    def find(self, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each conversation, and whether there is one."""
        at = np.minimum(np.searchsorted(self.ids, conv), max(len(self.ids) - 1, 0))
        return at, (self.ids[at] == conv) if len(self.ids) else np.zeros(len(conv), bool)


def paths(local: DataFrame, carries: _Carries, n: int) -> DataFrame:
    """(part, conv_id, depth, k1, k2, p1, p2, chars, is_end): the nodes of each rebuilt conversation, with their parents'
    keys and whether it ends there."""
    shared = local.sparkSession.sparkContext.broadcast(carries)
    rows = local.repartition(n, "part").sortWithinPartitions("part", "conv_id", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        lead, opened = None, None  # the last lead seen; the conversation that goes on from the last slice, with what it adds

        def written(table: pa.Table, held: tuple[int, int] | None) -> pa.RecordBatch:
            nonlocal lead, opened
            part, conv, h, i, chars = (table.column(c).to_numpy() for c in ("part", "conv_id", "h", "i", "chars"))
            x, p, i, h = _lanes(table, "x1", "x2"), _lanes(table, "p1", "p2"), i.copy(), h.astype(np.int64)
            heads = dict([lead]) if lead else {}
            start = firsts(part, conv)
            size = np.diff(np.append(start, len(conv)))
            for q in np.unique(part).tolist():
                for c in (known.first[q], _base(known.first[q])):
                    if c in known.heads:
                        heads[c] = known.heads[c]
                if q in known.before:
                    more = (part == q) & (conv == known.before[q][0])
                    p[more] += known.before[q][2] * _powers(_STEP, i[more])
                    i[more] += known.before[q][1]
            for s in start[(conv[start] % BLOCK == 0) & (i[start] == 1)].tolist():
                c = int(conv[s])
                if c in known.heads:
                    heads[c] = known.heads[c]
                else:
                    e = s + min(HEADS, int(size[np.searchsorted(start, s)]))
                    heads[c] = np.concatenate([np.zeros((1, 2), np.uint64), p[s:e]]), np.append(0, chars[s:e])
            leads = _Leads(heads)
            own, sh = conv[start], h[start]
            at, there = leads.find(_base(own))
            m = np.where(there, np.minimum(sh, leads.n[at] if len(leads.ids) else 0), 0)
            top = np.where(there[:, None], leads.p[at, m] if len(leads.ids) else 0, np.uint64(0)).astype(np.uint64)
            # The polynomial of the conversation's own first h turns: in these rows, or known from an earlier partition.
            cut, row = np.zeros((len(start), 2), np.uint64), start + sh - i[start]
            here = (sh > 0) & (row >= start) & (row < start + size)
            cut[here] = p[row[here]]
            for k in np.flatnonzero(~here & (sh > 0) & (i[start + size - 1] > sh)).tolist():
                if opened and opened[0] == (part[start[k]], own[k]):
                    continue
                cut[k] = known.heads[int(own[k])][0][sh[k]]
            adds = top - cut
            if opened and len(start) and opened[0] == (part[start[0]], own[0]):
                adds[0], m[0] = opened[1], opened[2]
            seg = np.repeat(np.arange(len(start)), size)
            last = start + size - 1
            goes_on = np.array([known.after.get(int(q)) == c for q, c in zip(part[start].tolist(), own.tolist())], bool)
            if held is not None and len(start) and held == (part[start[-1]], own[-1]):
                goes_on[-1] = True
            # Own turns after the first h.
            live = np.flatnonzero(i > h)
            by = seg[live]
            key = adds[by] * _powers(_STEP, i[live] - h[live]) + p[live]
            up = (key - x[live]) * _BACK
            end = (last[by] == live) & ~goes_on[by]
            # The lead's turns, and the root, once for each conversation.
            new = np.flatnonzero(i[start] == 1)
            depth = np.arange((m[new] + 1).sum()) - np.repeat(np.cumsum(m[new] + 1) - m[new] - 1, m[new] + 1)
            of = np.repeat(new, m[new] + 1)
            length = np.array([len(known.heads[c][1]) - 1 if c in known.heads else k for c, k in zip(own[new].tolist(), size[new].tolist())], np.int64)
            short = np.zeros(len(start), bool)
            short[new] = length <= sh[new]
            if len(leads.ids):
                base_key = np.where(depth[:, None] > 0, leads.p[at[of], depth], np.uint64(0))
                base_up = np.where(depth[:, None] > 1, leads.p[at[of], np.maximum(depth - 1, 0)], np.uint64(0))
                base_chars = np.where(depth > 0, leads.chars[at[of], depth], 0)
            else:
                base_key = base_up = np.zeros((len(of), 2), np.uint64)
                base_chars = np.zeros(len(of), np.int64)
            columns = [
                np.concatenate([part[start[of]], part[live]]),
                np.concatenate([own[of], conv[live]]),
                np.concatenate([depth, m[by] + i[live] - h[live]]),
                *np.concatenate([base_key, key]).view(np.int64).T,
                *np.concatenate([base_up, up]).view(np.int64).T,
                np.concatenate([base_chars, chars[live]]),
                np.concatenate([(depth == m[of]) & short[of], end]),
            ]
            order = np.lexsort((columns[2], columns[1], columns[0]))
            if len(start):
                opened = ((part[start[-1]], own[-1]), adds[-1], m[-1]) if held is not None and held == (part[start[-1]], own[-1]) else None
                if there[-1]:
                    lead = (int(_base(own[-1])), heads[int(_base(own[-1]))])
            return pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], ["part", "conv_id", *_KEY, "p1", "p2", "chars", "is_end"])

        rest = None
        for table in gathered(batches, _ROWS):
            table = table if rest is None else pa.concat_tables([rest, table])
            part, conv, i = (table.column(c).to_numpy() for c in ("part", "conv_id", "i"))
            begin = int(firsts(part, conv)[-1])
            # The last turn waits, as it may be its conversation's last; short beginnings of conversations wait whole.
            cut = begin if len(conv) - begin <= HEADS and i[begin] == 1 else len(conv) - 1
            rest = table.slice(cut)
            if cut:
                yield written(table.slice(0, cut), (part[cut], conv[cut]))
        if rest is not None:
            yield written(rest, None)

    return rows.mapInArrow(run, "part int, conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, chars long, is_end boolean")


def _grouped(table: pa.Table, names: list[str]) -> tuple[pa.Table, np.ndarray]:
    """Rows in the order of names, and where each group of them begins."""
    order = np.lexsort([table.column(c).to_numpy() for c in reversed(names)])
    table = table.take(pa.array(order))
    return table, firsts(*(table.column(c).to_numpy() for c in names))


def node_tables(path: DataFrame) -> DataFrame:
    """(part, node key, p1, p2, chars, n_convs, n_ends, conv_id): the nodes of a partition's rows, combined there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, _ROWS):
            table, at = _grouped(table, _KEY)
            n = np.diff(np.append(at, table.num_rows))
            first = table.take(pa.array(at)).combine_chunks()
            ends = np.add.reduceat(table.column("is_end").to_numpy().astype(np.int64), at)
            least = np.minimum.reduceat(table.column("conv_id").to_numpy(), at)
            keep = ["part", *_KEY, "p1", "p2", "chars"]
            yield pa.RecordBatch.from_arrays([*(first.column(c).combine_chunks() for c in keep), pa.array(n), pa.array(ends), pa.array(least)], [*keep, "n_convs", "n_ends", "conv_id"])

    return path.mapInArrow(run, "part int, depth long, k1 long, k2 long, p1 long, p2 long, chars long, n_convs long, n_ends long, conv_id long")


def merged(tables: DataFrame, n: int) -> DataFrame:
    """(node key, p1, p2, chars, n_convs, n_ends, conv_id) of the node tables of n parts, in rounds of FAN to one."""
    while True:
        n = -(-n // FAN)
        group = [*_KEY, *([(F.col("part") % n).alias("part")] if n > 1 else [])]
        tables = tables.groupBy(*group).agg(*[F.min(c).alias(c) for c in ("p1", "p2", "chars")], *[F.sum(c).alias(c) for c in ("n_convs", "n_ends")], F.min("conv_id").alias("conv_id"))
        if n == 1:
            return tables


def end_digests(path: DataFrame, n: int) -> DataFrame:
    """(node key, ends_sha256) of the nodes where conversations end."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, _ROWS):
            table, at = _grouped(table, [*_KEY, "part", "conv_id"])
            at = firsts(*(table.column(c).to_numpy() for c in [*_KEY, "part"]))
            stop = np.append(at, table.num_rows)[1:]
            conv = table.column("conv_id").to_numpy()
            cuts = [(a, min(a + RUN, e)) for s, e in zip(at.tolist(), stop.tolist()) for a in range(s, e, RUN)]
            first = table.take(pa.array([a for a, _ in cuts])).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(first.column(c).combine_chunks() for c in [*_KEY, "conv_id"]), pa.array([",".join(map(str, conv[a:e].tolist())) for a, e in cuts])], [*_KEY, "conv_id", "ids"])

    found = path.filter("is_end").select(*_KEY, "part", "conv_id").mapInArrow(runs, "depth long, k1 long, k2 long, conv_id long, ids string")
    dealt = found.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "conv_id")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([d[0][k] for d in done], pa.int64()) for k in range(3)), pa.array([d[1].hexdigest() for d in done], pa.string())], [*_KEY, "ends_sha256"])

        key, state = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
                if node == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((key, state))
                key, state = node, hashlib.sha256(ids.encode())
            yield out(done)
        if key is not None:
            yield out([(key, state)])

    return dealt.mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _chain_sums(shared: DataFrame) -> DataFrame:
    """(node key, conv_id, saved) of nodes with several members: what the owner's chain saves from there on down, by sums of
    blocks of depths and within them, so that a chain of any length is no single group."""
    rows = shared.select(*_KEY, "conv_id", ((F.col("n_convs") - 1) * F.col("chars")).alias("saves"), F.floor(F.col("depth") / DEPTHS).alias("block"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("saves").alias("saves")).withColumn("under", F.coalesce(F.sum("saves").over(below), F.lit(0)))
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("saves").over(within)).join(blocks.drop("saves"), ["conv_id", "block"])
    return rows.select(*_KEY, "conv_id", (F.col("upto") + F.col("under")).alias("saved"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    n = partitions(conversations)
    local = durable(turns(conversations, n), "turns")
    carries = _carries(local)
    path = durable(paths(local, carries, n), "paths")
    forget(local)
    nodes = durable(merged(node_tables(path), n), "nodes")

    # A conversation's chain: the nodes that it owns, what they save, and whether the lowest is a leaf.
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("int")
    top = F.min_by(F.struct(*_KEY, "p1", "p2"), "depth")
    chains = nodes.groupBy("conv_id").agg(top.alias("top"), F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.max(leaf).cast("long").alias("leaves"))
    chains = durable(chains.select("conv_id", F.col("top.depth").alias("from"), F.col("top.k1").alias("k1"), F.col("top.k2").alias("k2"), F.col("top.p1").alias("p1"), F.col("top.p2").alias("p2"), "saved", "leaves"), "chains")
    # Only conversations that lie in several partitions can have more rows than a partition: one for each partition at most.
    long = sorted({int(c) for c in carries.after.values()})
    sums = path.select("conv_id", *_KEY)
    given = joined(sums, chains.select("conv_id", "from", "saved", "leaves"), ["conv_id"], "conv_id", long).filter(F.col("depth") < F.col("from"))
    shared = nodes.filter("n_convs > 1")
    own = joined(_chain_sums(shared), chains.select("conv_id", "leaves"), ["conv_id"], "conv_id", long)

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    children = durable(children, "children")
    total = nodes.count()
    hot = [row.k1 for row in children.filter(F.col("n_children") > F.lit(total) / HOT).select("k1").collect()]
    asked = chains.filter("from > 0").select((F.col("from") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.struct(F.col("from").alias("depth"), "k1", "k2").alias("node"))
    parents = joined(asked, nodes.select(*_KEY, "conv_id"), _KEY, "k1", hot).select("node.*", F.col("conv_id").alias("parent_conv_id"))

    kinds = {"conv_id": "long", "n_convs": "long", "parent_conv_id": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}

    def told(rows: DataFrame, **columns) -> DataFrame:
        return rows.select(*_KEY, *[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])

    alone = F.when(F.col("n_convs") == 1, 1)
    all_of = [
        told(nodes, conv_id=F.col("conv_id"), n_convs=F.col("n_convs"), n_leaves=alone),
        told(own, n_leaves=F.col("leaves"), saved_tokens=F.col("saved")),
        told(given, n_leaves=F.col("leaves"), saved_tokens=F.col("saved")),
        told(children, n_children=F.col("n_children")),
        told(parents, parent_conv_id=F.col("parent_conv_id")),
        told(end_digests(path, n), ends_sha256=F.col("ends_sha256")),
    ]
    rows = all_of[0]
    for more in all_of[1:]:
        rows = rows.unionByName(more)
    adds = {"n_children", "n_leaves", "saved_tokens"}
    rows = rows.groupBy(*_KEY).agg(*[(F.coalesce(F.sum(c), F.lit(0).cast("long")) if c in adds else F.max(c)).alias(c) for c in kinds])
    return rows.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id"))).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
