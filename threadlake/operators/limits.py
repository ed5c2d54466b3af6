"""Request limits: windows that start at a key's first request, and rolling latency budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.functions.placing import together


def first_request_windows(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(key, at, id, ok, remaining, retry_after) of requests (key, at, id): a key's window opens with a request that no
    window covers and takes `limit` requests; the rest wait for its end.

    Requests stream through tasks in order of key and time with one window in hand, so a key with a third of all rows
    costs time, not memory. Rows with a null key or time are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, start, count = None, 0, 0
        for batch in batches:
            ok, left, wait = [], [], []
            for key, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != held or at - start >= seconds:
                    held, start, count = key, at, 0
                fits = count < limit
                count += fits
                ok.append(fits)
                left.append(limit - count)
                wait.append(0 if fits else start + seconds - at)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(ok, pa.bool_()), pa.array(left, pa.int64()), pa.array(wait, pa.int64())], ["key", "at", "id", "ok", "remaining", "retry_after"])

    rows = requests.select(F.col("key").cast("long"), F.col("at").cast("long"), F.col("id").cast("long")).filter("key IS NOT NULL AND at IS NOT NULL")
    return together(rows, ["key"], "at", "id").mapInArrow(run, "key long, at long, id long, ok boolean, remaining long, retry_after long")


def floor_rank(values: Column, percent: int) -> Column:
    """The value at place floor(n * percent / 100), at most n - 1, of an array in order."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), (F.least(F.floor(n * percent / 100), n - 1) + 1).cast("int"))


def adaptive_timeouts(samples: DataFrame, floor: float, cap: float, tier: float = 1.0, size: float = 1.0, rolling: int = 20, least: int = 3, factor: float = 3.0) -> DataFrame:
    """samples (key, at, id, ms, size) with timeout: after each, 95 % of the key's last latencies by size, times factor,
    within floor and cap; with fewer than `least` samples the floor by tier."""
    recent = Window.partitionBy("key").orderBy("at", "id").rowsBetween(1 - rolling, 0)
    per = F.col("ms") / F.greatest(F.col("size"), F.lit(1))
    rows = samples.withColumn("_recent", F.collect_list(per).over(recent))
    grown = F.least(F.greatest(floor_rank(F.col("_recent"), 95) * factor * max(size, 1), F.lit(floor)), F.lit(cap))
    few = F.least(F.lit(floor * tier * max(size, 1)), F.lit(cap))
    return rows.withColumn("timeout", F.when(F.size("_recent") < least, few).otherwise(grown)).drop("_recent")
