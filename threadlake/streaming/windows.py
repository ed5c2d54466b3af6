"""Event streams: windows that close after a pause, events taken once, and rolling health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounced(events: DataFrame, gap: str, key: str = "key", at: str = "at", late: str = "1 minute") -> DataFrame:
    """(key, start, end, n, last_id): of each burst of events with pauses below gap the last one; events: (key, at, id).
    Works on batches and, with a watermark of `late`, on streams."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    burst = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("id", F.struct(at, "id")).alias("last_id"))
    return burst.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last_id")


def once(events: DataFrame, key: str = "event_id", at: str = "at", late: str = "1 day") -> DataFrame:
    """Every event once by its key; on a stream repeats are known for as long as the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def cooled_down(requests: DataFrame, seconds: int) -> DataFrame:
    """requests (key, at, id, count) whose key was not seen in the last `seconds`, or with another count."""
    w = Window.partitionBy("key").orderBy("at", "id")
    before, was = F.lag("at").over(w), F.lag("count").over(w)
    return requests.withColumn("_pass", before.isNull() | (F.col("at") - before >= seconds) | ~was.eqNullSafe(F.col("count"))).filter("_pass").drop("_pass")


def request_windows_stream(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """`operators.limits.first_request_windows` over a stream: (key, at, id, ok, remaining) of requests (key, at, id)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        start, count = group.get if group.exists else (None, 0)
        out = []
        for at, id_ in pd.concat(list(parts)).sort_values(["at", "id"])[["at", "id"]].itertuples(index=False):
            if start is None or at - start >= seconds:
                start, count = at, 0
            ok = count < limit
            count += ok
            out.append((key[0], at, id_, ok, limit - count))
        group.update((int(start), int(count)))
        yield pd.DataFrame(out, columns=["key", "at", "id", "ok", "remaining"])

    return requests.groupBy("key").applyInPandasWithState(run, "key long, at long, id long, ok boolean, remaining long", "start long, count long", "append", GroupStateTimeout.NoTimeout)


def health_stream(captures: DataFrame, last: int = 20, least: int = 8, floor: float = 0.6) -> DataFrame:
    """After each micro-batch, for the platforms in it: (platform, n, success, alert) over their last captures
    (platform, at, ok); an alert needs `least` of them and a success rate below floor."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = list(group.get[0]) if group.exists else []
        held = (held + [bool(x) for x in pd.concat(list(parts)).sort_values("at")["ok"]])[-last:]
        group.update((held,))
        rate = sum(held) / len(held)
        yield pd.DataFrame({"platform": [key[0]], "n": [len(held)], "success": [rate], "alert": [len(held) >= least and rate < floor]})

    return captures.groupBy("platform").applyInPandasWithState(run, "platform string, n long, success double, alert boolean", "held array<boolean>", "update", GroupStateTimeout.NoTimeout)


def flushed(rows: DataFrame, path: str, checkpoint: str, key: str, at: str, every: str = "30 seconds"):
    """Start a query that writes each interval's rows to a folder, the newest of each key."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), at).alias("x")).select("x.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
