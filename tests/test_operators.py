import json
import os
import random

import pytest
from pyspark.sql import functions as F
from threadlake.operators import chunking, limits, merging, retrieval, sessions, summaries
from threadlake.plans import operator_oracles, operator_queries
from threadlake.sources import samples
from threadlake.streaming import assembly, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_operator_query_has_its_own_oracle():
    assert set(operator_queries.QUERIES) == set(operator_oracles.ORACLES)


def test_chunks_of_code_and_prose(spark):
    text = "Intro sentence that is long enough.\n```py\nx = 1\n```\nshort\n``` \n```tail that never ends, so it stays as text of its own"
    got = chunking.chunk_messages(spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", None), (1, 2, "user", ""), (None, 0, "user", "no session, but twenty characters")], "session_id long, message_index long, role string, content string"))
    found = {(r.session_id, r.part_index): (r.has_code, r.language, r.text) for r in got.collect()}
    assert found[1, 1] == (True, "py", "x = 1\n")
    assert found[1, 0] == (False, None, "Intro sentence that is long enough.")
    assert (None, 0) in found and len(found) == 4


def test_packing_never_exceeds_the_target_by_more_than_a_sentence(spark):
    long = " ".join(f"This is sentence {i}." for i in range(500))
    pieces = spark.range(1).select(F.explode(chunking.packed(F.lit(long))).alias("p")).collect()
    assert " ".join(r.p for r in pieces) == long and max(len(r.p) for r in pieces) < 900


def test_newest_chunks_stay(spark):
    many = spark.range(300).select(F.lit(1).alias("session_id"), F.col("id").alias("message_index"), F.lit("user").alias("role"), F.lit("a sentence of more than twenty characters").alias("content"))
    kept = chunking.chunk_messages(many, newest=50)
    assert kept.count() == 50 and kept.agg(F.min("message_index")).first()[0] == 250


def test_nearest_with_odd_vectors(spark):
    data = [(1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (2, 3, [0.0, 1.0]), (3, 4, [0.0, 0.0]), (4, 5, None), (5, 6, [1.0]), (None, 7, [1.0, 1.0]), (6, 8, [-1.0, 0.0])]
    vectors = spark.createDataFrame(data, "owner long, id long, vector array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, vector array<double>")
    got = rows(retrieval.nearest(vectors, queries, 3))
    assert got[:3] == [(1, 1, 1, 1.0), (1, 2, 3, 0.0), (1, 3, 4, 0.0)]
    assert [r for r in got if r[0] == 2] == [(2, 1, 1, 0.0), (2, 2, 3, 0.0), (2, 3, 4, 0.0)] and sum(r[0] == 3 for r in got) == 3
    assert retrieval.nearest(vectors, queries.limit(0), 3).count() == 0 and retrieval.nearest(vectors.limit(0), queries, 3).count() == 0


def test_nearest_in_blocks_is_the_same(spark, monkeypatch):
    vectors = spark.range(500).select((F.col("id") % 50).alias("owner"), "id", F.array(*[F.sin(F.col("id") * k) for k in range(1, 9)]).alias("vector"))
    queries = vectors.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")
    whole = rows(retrieval.nearest(vectors, queries, 4))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 8 * 8 * 16)
    assert rows(retrieval.nearest(vectors.repartition(7), queries, 4)) == whole and len(whole) == 200


@pytest.mark.parametrize("scores, want", [([0.5, 0.7, 0.5, 0.5, 0.3], [0.5, 0.7, 0.7, 0.7, 0.3]), ([0.5, 0.5, 0.8], [0.5, 0.7, 0.8]), ([0.4, 0.9, 0.2], [0.4, 0.9, 0.2]), ([0.6], [0.6])])
def test_boost_cascades_forward_only(spark, scores, want):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "session_id long, message_index long, score double")
    want = [0.7 if i == 0 and scores[:2] == [0.5, 0.7] else w for i, w in enumerate(want)]
    assert [r.boosted for r in retrieval.boosted(df, 0.7, "session_id").orderBy("message_index").collect()] == want


def test_partial_merge_keeps_the_longer_copy(spark):
    a = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "user", "hello")], "session_id long, message_index long, role string, content string")
    b = spark.createDataFrame([(1, 0, "user", "hello "), (1, 1, "assistant", "new"), (1, 2, "assistant", "new")], "session_id long, message_index long, role string, content string")
    assert rows(merging.merge_partial(a, b)) == [(1, 0, "user", "hello "), (1, 1, "user", "hello"), (1, 2, "assistant", "new")]


def test_ties_go_to_the_pending_snapshot(spark):
    one = spark.createDataFrame([(1, 3), (2, 5)], "session_id long, n long")
    two = spark.createDataFrame([(1, 3), (2, 4), (3, 1)], "session_id long, n long")
    assert rows(merging.best_known(one, two)) == [(1, 3, "pending"), (2, 5, "stored"), (3, 1, "pending")]


WANT = [(1, "m1", "assistant", "Hello there friend"), (2, "c9", "assistant", "One two"), (3, "u", "user", "typed text"), (4, "k", "assistant", "a much longer replacement"), (6, "b1", "assistant", "Block text"), (7, "p1", "assistant", "The whole answer")]


def test_streams_are_assembled(spark):
    assert rows(assembly.assemble(samples.frame(spark, samples.STREAMS, samples.STREAM_COLUMNS).repartition(5))) == WANT


def test_the_same_over_micro_batches(spark, tmp_path):
    for n, part in enumerate((samples.STREAMS[:3], samples.STREAMS[3:8], samples.STREAMS[8:])):
        (tmp_path / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("stream_id", "line_number", "line"), r))) for r in part))
        os.utime(tmp_path / f"{n}.json", (n + 1, n + 1))
    lines = spark.readStream.schema(samples.STREAM_COLUMNS).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    query = assembly.assemble_stream(lines).writeStream.format("memory").queryName("assembled").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    longest = spark.table("assembled").groupBy("stream_id", "message_id", "role").agg(F.max_by("content", F.length("content")).alias("content"))
    assert rows(longest) == WANT


def test_request_windows_as_a_stream(spark, tmp_path):
    data = [(1, t, i) for i, t in enumerate((0, 1, 2, 9, 10, 11, 30))] + [(2, 5, 90)]
    for n in range(2):
        (tmp_path / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("key", "at", "id"), r))) for r in (data[:4], data[4:])[n]))
        os.utime(tmp_path / f"{n}.json", (n + 1, n + 1))
    schema = "key long, at long, id long"
    query = windows.request_windows_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path)), 2, 10).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = limits.first_request_windows(spark.createDataFrame(data, schema), 2, 10)
    assert rows(spark.table("limited")) == rows(batch.select("key", "at", "id", "ok", "remaining"))
    assert [r.ok for r in batch.filter("key = 1").orderBy("at").collect()] == [True, True, False, False, True, True, True]


def test_bursts_and_repeats(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 9, 3), (2, 0, 4)], "key long, s long, id long").withColumn("at", F.timestamp_seconds("s"))
    assert sorted((r.key, r.n, r.last_id) for r in windows.debounced(e, "2 seconds").collect()) == [(1, 1, 3), (1, 2, 2), (2, 1, 4)]
    twice = spark.createDataFrame([("a",), ("a",), ("b",)], "event_id string")
    assert windows.once(twice).count() == 2
    asked = spark.createDataFrame([(1, 0, 1, 5), (1, 10, 2, 5), (1, 20, 3, 6), (1, 90, 4, 6)], "key long, at long, id long, count long")
    assert [r.id for r in windows.cooled_down(asked, 60).orderBy("id").collect()] == [1, 3, 4]


def test_histories(spark):
    node = lambda i, role, t, *parts: {"message": {"id": i, "author": {"role": role}, "content": {"parts": list(parts)}, "create_time": t}}
    body = json.dumps({"mapping": {"x": node("x", "assistant", 2.0, "second"), "y": node("y", "user", 1.0, "fir", "st"), "z": node("z", "system", 0.0, "no"), "e": node("e", "user", 3.0, " "), "root": {"message": None}}})
    got = assembly.history_messages(spark.createDataFrame([(1, body), (2, "{broken"), (3, None)], "history_id long, body string"))
    assert rows(got) == [(1, 0, "user", "first"), (1, 1, "assistant", "second")]


def test_health_as_a_stream(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.json").write_text("\n".join(json.dumps({"platform": "p", "at": 100 * n + i, "ok": n == 0}) for i in range(12)))
        os.utime(tmp_path / f"{n}.json", (n + 1, n + 1))
    stream = spark.readStream.schema("platform string, at long, ok boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    query = windows.health_stream(stream).writeStream.format("memory").queryName("health").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("health")) == [("p", 12, 1.0, False), ("p", 20, 0.4, True)]


def test_flushed_keeps_the_newest_of_each_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"key":1,"at":1}\n{"key":1,"at":2}\n{"key":2,"at":1}')
    stream = spark.readStream.schema("key long, at long").json(str(tmp_path / "in"))
    query = windows.flushed(stream, str(tmp_path / "out"), str(tmp_path / "check"), "key", "at", "1 second")
    query.processAllAvailable()
    query.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("key", "at")) == [(1, 2), (2, 1)]


def test_no_category_and_no_limit_is_dropped(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id long, vector array<double>")
    many = spark.range(150).select(F.col("id").alias("category"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector"))
    got = retrieval.category_scores(vectors, many)
    assert got.count() == 450 and got.filter("id > 1 AND score <> 0").count() == 0
    used = spark.range(1500).select(F.col("id").alias("user_id"), F.col("id").cast("string").alias("tier"), F.lit(1).alias("used"))
    limits_of = used.select("tier", F.lit(5).cast("long").alias("allowance"))
    assert merging.usage_decision(used, limits_of).count() == 1500
    assert retrieval.category_scores(vectors, many.limit(0)).count() == 0


def merged_by_hand(stored, incoming, longest, full):
    fp = lambda m: m[1] + "::" + " ".join(m[2][:80].split())
    if sum(len(m[2]) for m in stored) >= full:
        return list(stored)
    out = list(stored)
    for m in incoming:
        m = m if len(m[2]) <= longest else (m[0], m[1], m[2][:longest] + f"\n\n[content truncated at {longest} chars]")
        at = next((i for i, o in enumerate(out) if m[0] and o[0] == m[0]), None)
        at = next((i for i, o in enumerate(out) if fp(o) == fp(m)), None) if at is None else at
        if at is None:
            out.append(m)
        elif len(m[2]) >= len(out[at][2]):
            out[at] = m
    return out


def test_captures_merge_as_one_by_one(spark):
    draw = random.Random(2)
    make = lambda: (draw.choice([None, "a", "b", "c", "d"]), draw.choice(["user", "assistant"]), draw.choice(["x", "y", "z z"]) * draw.randint(1, 60))
    sides = {s: ([make() for _ in range(draw.randint(0, 6))], [make() for _ in range(draw.randint(0, 8))]) for s in range(60)}
    frame = lambda j: spark.createDataFrame([(s, i, *m) for s, x in sides.items() for i, m in enumerate(x[j])], "session_id long, message_index long, message_id string, role string, content string").repartition(3)
    got = rows(merging.merge_captures(frame(0), frame(1), 100, 400).select("session_id", "place", F.coalesce("message_id", F.lit("-")), "role", "content"))
    assert got == sorted((s, i, m[0] or "-", m[1], m[2]) for s, x in sides.items() for i, m in enumerate(merged_by_hand(*x, 100, 400)))


def test_captures_stay_whole_whatever_the_shuffles(spark):
    """A session's stored and incoming messages meet in one task, also where both sides' shuffles are coalesced apart."""
    conf = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in conf}
    make = lambda n, longer: spark.createDataFrame([(s, i, None, "user", f"{i}" * (900 if longer and s % 10 == 0 else 20)) for s in range(200) for i in range(n)], "session_id long, message_index long, message_id string, role string, content string")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = merging.merge_captures(make(6, True), make(3, False), 1000, 400).select("session_id", "place").collect()
        requests = spark.createDataFrame([(k, 10 * i, i) for k in range(200) for i in range(6)], "key long, at long, id long")
        known = requests.groupBy("key").count().filter("count > 1").select("key")
        both = requests.join(known, "key").unionByName(requests.filter("id < 3").selectExpr("key", "at + 5 AS at", "id + 10 AS id").join(known, "key"))
        ok = limits.first_request_windows(both, 2, 1000).filter("ok").groupBy("key").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(s, i) for s in range(200) for i in range(6)]
    assert len(ok) == 200 and {r["count"] for r in ok} == {2}


def test_summary_items_fit_any_budget(spark):
    """Sections give up items as a walk through them would."""
    draw = random.Random(8)
    items = [(s, section, place, "x" * draw.randint(1, 90)) for s in range(300) for section in summaries.FLOORS for place in range(1, draw.randint(0, 7) + 1)]
    fixed = [(s, draw.randint(0, 120)) for s in range(0, 300, 2)]
    got = rows(summaries.trimmed(spark.createDataFrame(items, "session_id long, section string, place long, text string"), spark.createDataFrame(fixed, "session_id long, tokens long"), 150).select("session_id", "section", "place"))
    want = []
    for s in range(300):
        lists = {k: [i for i in items if i[0] == s and i[1] == k] for k in summaries.FLOORS}
        over = sum(-(-len(i[3]) // 4) for x in lists.values() for i in x) + dict(fixed).get(s, 0) - 150
        for k, floor in summaries.FLOORS.items():
            while over > 0 and len(lists[k]) > floor:
                over -= -(-len(lists[k].pop()[3]) // 4)
        want += [i[:3] for x in lists.values() for i in x]
    assert got == sorted(want)


def test_smallest_rows_equal_a_sort(spark):
    rng = random.Random(2)
    for n, values in ((40, 3), (3000, 7), (3000, 100_000)):
        data = [(rng.choice([None, *range(values)]) if values < 10 else rng.randrange(values), i) for i in range(n)]
        df = spark.createDataFrame(data, "at long, id long").repartition(5)
        order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for k in (0, 1, n // 5, n - 1, n, n + 1):
            got = [tuple(r) for r in sessions.smallest(df, ["at", "id"], k).collect()]
            assert len(got) == min(k, n) and set(got) == set(order[:k])
    twice = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "at long, id long")
    assert sessions.smallest(twice, ["at", "id"], 1).count() == 2 and sessions.evicted(twice, 3, "at", "id").count() == 0
