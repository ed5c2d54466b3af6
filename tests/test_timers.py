"""Streams on transformWithState against the same rules over batches."""

import json
import os

import pytest
from pyspark.sql import functions as F
from threadlake.sources import samples
from threadlake.streaming import assembly, timers


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, timers.PROVIDER)
    yield
    spark.conf.set(key, before)


def stream(spark, folder, batches, schema):
    """One micro-batch for each list of rows."""
    for n, batch in enumerate(batches):
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, batch)))
        os.utime(folder / f"{n}.json", (n + 1, n + 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    return sorted(tuple(r) for r in spark.table(name).collect())


def stamp(second):
    return f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


EVENTS = [[(1, 0), (2, 1), (1, 2)], [(1, 4), (2, 30), (1, 6)], [(1, 8), (1, 9), (1, 11)], [(2, 31), (1, 60)], [(1, 61), (1, 64), (3, 66)], [(9, 500)], [(9, 501)]]


@pytest.mark.parametrize("name, rule", [("flushes", lambda e: timers.flushes(e, 3, 7)), ("admissions", lambda e: timers.admissions(e, 10, 1, 8))])
def test_stream_and_batch_agree(spark, tmp_path, store, name, rule):
    start, n = 1704067200, iter(range(1000))
    numbered = [[(k, at, next(n)) for k, at in batch] for batch in EVENTS]
    batches = [[{"key": k, "at": stamp(at), "id": i} for k, at, i in batch] for batch in numbered]
    got = run(spark, rule(stream(spark, tmp_path, batches, "key long, at timestamp, id long")), name)
    every = spark.createDataFrame([(k, start + at, i) for batch in numbered for k, at, i in batch], "key long, at long, id long")
    want = sorted(tuple(r) for r in rule(every.repartition(3)).collect())
    # What the last batch's key waits for has no later event to pass the watermark.
    assert [r for r in got if r[0] != 9] == [r for r in want if r[0] != 9] and got


def test_ended_streams_are_handed_out_once_and_forgotten(spark, tmp_path, store):
    lines = [(s, i, line) for s, i, line in samples.STREAMS]
    batches = [[{"stream_id": s, "at": stamp(10 * b), "line_number": i, "line": line} for s, i, line in lines if i % 2 == b] for b in range(2)]
    batches[1] = [{**r, "at": stamp(10)} for r in batches[1]]
    ordered = [[{"stream_id": s, "at": stamp(i), "line_number": i, "line": line} for s, i, line in lines if lo <= i < hi] for lo, hi in ((0, 2), (2, 9))]
    end = [[{"stream_id": 99, "at": stamp(500 + i), "line_number": 0, "line": ""}] for i in range(2)]
    query = timers.ended_streams(stream(spark, tmp_path, ordered + end, "stream_id long, at timestamp, line_number long, line string"), 60)
    got = run(spark, query, "ended")
    want = sorted(tuple(r) for r in assembly.assemble(samples.frame(spark, samples.STREAMS, samples.STREAM_COLUMNS)).collect())
    assert got == want


def test_no_events(spark):
    empty = spark.createDataFrame([], "key long, at long, id long")
    assert timers.flushes(empty, 3, 7).count() == timers.admissions(empty).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (1, None, 2), (1, 5, None), (1, 5, 3)], "key long, at long, id long")
    assert [tuple(r) for r in timers.flushes(odd, 3, 7).select("key", "fired_at", "n").collect()] == [(1, 8, 2)]
    assert odd.filter(F.col("key").isNull()).count() == 1
