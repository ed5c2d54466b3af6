"""Keyed writes as joins: the rows of a table and those that come in give the rows that replace it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.functions.placing import together
from threadlake.functions.text import fingerprint


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new put in by key; of a row in both, the columns of keep stay as they were. One row a key in
    each is expected; columns that new lacks stay too."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    met = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")

    def column(name: str) -> Column:
        if name not in new.columns:
            return F.col(f"o.{name}")
        if name in keys or name in keep:
            return F.coalesce(f"o.{name}", f"n.{name}").alias(name)
        return F.when(F.col("n._new"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    return met.select(*(column(c) for c in old.columns))


def best_known(stored: DataFrame, pending: DataFrame, key: str = "session_id", size: str = "n") -> DataFrame:
    """(key, size, source): of two snapshots of a session the one with more messages; of equal ones the pending one."""
    both = stored.select(key, size, F.lit("stored").alias("source")).unionByName(pending.select(key, size, F.lit("pending").alias("source")))
    best = both.groupBy(key).agg(F.max(F.struct(size, F.when(F.col("source") == "pending", 1).otherwise(0).alias("rank"), "source")).alias("b"))
    return best.select(key, F.col(f"b.{size}").alias(size), "b.source")


def accepted(incoming: DataFrame, known: DataFrame, key: str = "session_id", size: str = "n") -> DataFrame:
    """The incoming snapshots that have no fewer messages than the known one."""
    have = known.select(key, F.col(size).alias("_have"))
    return incoming.join(have, key, "left").filter(F.col("_have").isNull() | (F.col(size) >= F.col("_have"))).drop("_have")


def full_history(incoming: DataFrame, known: DataFrame, key: str = "session_id", size: str = "n", share: float = 0.8) -> DataFrame:
    """The incoming histories of two messages or more that have at least a share of the messages known."""
    have = known.select(key, F.col(size).alias("_have"))
    return incoming.filter(F.col(size) >= 2).join(have, key, "left").filter(F.col(size) >= share * F.coalesce("_have", F.lit(0))).drop("_have")


def merge_partial(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(session_id, place, role, content) of messages (session_id, message_index, role, content).

    An incoming message meets the first stored one with its fingerprint, role and first 80 characters; of several that
    meet the same one the last whose content is as long as what is there by then stays. The others are added at the end
    in their order; those that are alike count as one in the same way."""

    def known(df: DataFrame, source: int) -> DataFrame:
        return df.select("session_id", F.lit(source).alias("source"), "message_index", "role", "content", fingerprint(F.col("role"), F.col("content")).alias("fp"))

    every = known(stored, 0).unionByName(known(incoming, 1))
    own = Window.partitionBy("session_id", "fp", "source").orderBy("message_index")
    every = every.withColumn("nth", F.when(F.col("source") == 0, F.row_number().over(own)).otherwise(1))
    slot = every.groupBy("session_id", "fp", "nth").agg(
        F.min(F.struct("source", "message_index")).alias("first"),
        # The longest, of equal ones the latest to come.
        F.max(F.struct(F.length("content").alias("length"), "source", "message_index", "role", "content")).alias("best"),
    )
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("first.source", "first.message_index")) - 1
    return slot.select("session_id", place.cast("bigint").alias("place"), "best.role", "best.content")


def merge_captures(stored: DataFrame, incoming: DataFrame, longest: int = 80_000, full: int = 500_000) -> DataFrame:
    """(session_id, place, message_id, role, content) of messages (session_id, message_index, message_id, role, content).

    Incoming messages, cut to `longest` characters with a note, come one by one: each meets the first message with its id, or
    else the first with its fingerprint, and replaces it unless it is shorter; else it is added. Where `full` characters are
    stored, nothing is merged; such sessions, however large, never come to a task of their own. Null contents are empty."""
    columns = ["session_id", "message_index", "message_id", "role", F.coalesce("content", F.lit("")).alias("content")]
    old, new = stored.select(*columns), incoming.select(*columns)
    size = old.groupBy("session_id").agg(F.sum(F.length("content")).alias("_size"))
    closed = size.filter(F.col("_size") >= full).select("session_id")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("message_index")) - 1
    left = old.join(closed, "session_id", "left_semi").select("session_id", place.cast("bigint").alias("place"), "message_id", "role", "content")
    cut = F.concat(F.substring("content", 1, longest), F.lit(f"\n\n[content truncated at {longest} chars]"))
    new = new.withColumn("content", F.when(F.length("content") > longest, cut).otherwise(F.col("content")))
    every = old.withColumn("_source", F.lit(0)).unionByName(new.withColumn("_source", F.lit(1))).join(closed, "session_id", "left_anti")
    every = every.withColumn("_fp", fingerprint(F.col("role"), F.col("content"))).withColumn("_length", F.length("content"))
    dealt = together(every.select("session_id", "_source", "message_index", "message_id", "role", "content", "_fp", "_length"), ["session_id"], "_source", "message_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(session: int, kept: list[tuple]) -> pa.RecordBatch:
            ids, roles, contents = ([k[j] for k in kept] for j in (0, 1, 2))
            return pa.RecordBatch.from_arrays([pa.array([session] * len(kept), pa.int64()), pa.array(range(len(kept)), pa.int64()), *(pa.array(c, pa.string()) for c in (ids, roles, contents))], ["session_id", "place", "message_id", "role", "content"])

        # One session's merged messages, and where each id and fingerprint is.
        session, kept, by_id, by_fp = None, [], {}, {}

        def put(at: int, message: tuple) -> None:
            if at < len(kept):
                for index, key in ((by_id, kept[at][0]), (by_fp, kept[at][3])):
                    index[key].discard(at)
                kept[at] = message
            else:
                kept.append(message)
            for index, key in ((by_id, message[0]), (by_fp, message[3])):
                index.setdefault(key, set()).add(at)

        for batch in batches:
            for s, source, _, *message in zip(*(c.to_pylist() for c in batch.columns)):
                if s != session:
                    if kept:
                        yield rows(session, kept)
                    session, kept, by_id, by_fp = s, [], {}, {}
                met = (by_id.get(message[0]) if message[0] else None) or by_fp.get(message[3]) if source else None
                at = min(met) if met else len(kept)
                if at == len(kept) or message[4] >= kept[at][4]:
                    put(at, tuple(message))
        if kept:
            yield rows(session, kept)

    merged = dealt.mapInArrow(run, "session_id long, place long, message_id string, role string, content string")
    return merged.unionByName(left)


def session_ends(messages: DataFrame, *more: str) -> DataFrame:
    """(session_id, n, first, last, more) of messages: their number and the first 200 characters of both ends."""
    head = F.substring("content", 1, 200)
    return messages.groupBy("session_id", *more).agg(F.count("*").alias("n"), F.min_by(head, "message_index").alias("first"), F.max_by(head, "message_index").alias("last"))


def pick_better(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(session_id, winner, n, updated_at, name) of sessions (session_id, n, first, last, updated_at, name) on both sides.

    Sides whose both ends differ are kept local, unless one has more than three times the messages of the other; else more
    messages win, then the newer one, then local. A name that only one side has stays; of two the newer side's."""
    met = local.alias("l").join(remote.alias("r"), "session_id", "full_outer")
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))  # noqa: E741
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    differ = filled(l("first")) & filled(r("first")) & (l("first") != r("first")) & filled(l("last")) & filled(r("last")) & (l("last") != r("last"))
    close = F.greatest(l("n"), r("n")) / F.greatest(F.lit(1), F.least(l("n"), r("n"))) <= 3
    clash = close & differ
    newer = F.coalesce(r("updated_at"), F.lit(0)) > F.coalesce(l("updated_at"), F.lit(0))
    winner = (
        F.when(r("n").isNull(), "local").when(l("n").isNull(), "remote").when(clash, "local")
        .when(l("n") > r("n"), "local").when(r("n") > l("n"), "remote").when(newer, "remote").otherwise("local")
    )
    own = F.when(winner == "local", l("name")).otherwise(r("name"))
    named_l, named_r = filled(F.trim(l("name"))), filled(F.trim(r("name")))
    name = F.when(l("n").isNull() | r("n").isNull() | clash, own).when(named_l & named_r, F.when(newer, r("name")).otherwise(l("name"))).when(named_l, l("name")).when(named_r, r("name")).otherwise(own)
    pick = lambda c: F.when(winner == "local", l(c)).otherwise(r(c)).alias(c)
    return met.select("session_id", winner.alias("winner"), pick("n"), pick("updated_at"), name.alias("name"))


def last_writer(local: DataFrame, cloud: DataFrame, key: str, updated: str = "updated_at") -> DataFrame:
    """Rows of both sides by key, of those on both the newer one; local stays on ties."""
    both = local.withColumn("_side", F.lit(1)).unionByName(cloud.withColumn("_side", F.lit(0)))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(updated), F.desc("_side"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_side")


def without(tables: dict[str, DataFrame], gone: DataFrame, key: str = "session_id") -> dict[str, DataFrame]:
    """Every table without the rows of the keys that are gone: a delete that cascades, a tombstone or an orphan's end."""
    keys = gone.select(key).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}


def tombstones(old: DataFrame, new: DataFrame, key: str = "session_id", at: str = "deleted_at", most: int = 200) -> DataFrame:
    """The newest `most` entries, one a key, of which the newly added one replaces the old."""
    added = new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
    one = added.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(at)))).filter("_r = 1")
    return one.orderBy(F.desc(at), key).limit(most).drop("_r", "_new")


def without_deleted(rows: DataFrame, entries: DataFrame, key: str = "session_id") -> DataFrame:
    """The rows whose key no tombstone (key, reason) names that a user set: reason user_deleted, or none in entries from before
    there were reasons. Rows with a null key stay."""
    gone = entries.filter("coalesce(reason, 'user_deleted') = 'user_deleted'").select(key).distinct()
    return rows.join(gone, key, "left_anti")


def first_sync(local: DataFrame, remote: DataFrame, key: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """What only the remote side has, to be seeded, and what only the local side has, to be uploaded."""
    return remote.join(local.select(key), key, "left_anti"), local.join(remote.select(key), key, "left_anti")


def manifest_status(manifest: DataFrame, chunks: DataFrame, messages: DataFrame, key: str = "session_id") -> DataFrame:
    """manifest with is_complete false where no chunk is there, or fewer than half the messages' number."""
    n_chunks = chunks.groupBy(key).agg(F.count("*").alias("_chunks"))
    n_messages = messages.groupBy(key).agg(F.count("*").alias("_messages"))
    met = manifest.join(n_chunks, key, "left").join(n_messages, key, "left")
    c, m = F.coalesce("_chunks", F.lit(0)), F.coalesce("_messages", F.lit(0))
    return met.withColumn("is_complete", F.col("is_complete") & (c > 0) & (c >= 0.5 * m)).drop("_chunks", "_messages")


def needs_indexing(sessions: DataFrame, manifest: DataFrame, chunks: DataFrame, model: str, key: str = "session_id") -> DataFrame:
    """(key, needed) of sessions (key, hash): complete with chunks is done, whatever the hash; then incomplete, another
    hash or model, or fewer than 80 % of the chunks counted at the time mean work."""
    have = chunks.groupBy(key).agg(F.count("*").alias("_have"))
    met = sessions.select(key, F.col("hash").alias("_hash")).join(manifest, key, "left").join(have, key, "left")
    n = F.coalesce("_have", F.lit(0))
    needed = (
        F.when(F.col("is_complete").isNull(), True).when(F.col("is_complete") & (n > 0), False).when(~F.col("is_complete"), True)
        .when((F.col("hash") != F.col("_hash")) | (F.col("model") != model), True).otherwise(n < 0.8 * F.col("chunk_count"))
    )
    return met.select(key, needed.alias("needed"))


def admitted(requests: DataFrame, limit: int, *keys: str, order: tuple[str, ...] = ("at", "id")) -> DataFrame:
    """requests with `used`, the number counted so far by key, and `allowed`: the first `limit` in order count."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return requests.withColumn("used", F.least(place, F.lit(limit)).cast("bigint")).withColumn("allowed", place <= limit)


def usage_decision(usage: DataFrame, limits: DataFrame, by: str = "tier") -> DataFrame:
    """usage with allowed, remaining and reason: what is at its limit is let through, with remaining 999 and a reason."""
    met = usage.join(limits, by)
    over = F.col("used") >= F.col("allowance")
    return met.withColumn("allowed", F.lit(True)).withColumn("remaining", F.when(over, F.lit(999)).otherwise(F.col("allowance") - F.col("used")).cast("bigint")).withColumn("reason", F.when(over, "limit_reached_promotional_unlocked"))
