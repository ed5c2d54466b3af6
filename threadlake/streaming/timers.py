"""Events that wait: flushes after a pause but no later than a longest wait, admissions with a cooldown, and response streams
that end. Each as a batch, where a key's events pass through a task in order with a constant state, and as a stream on
`transformWithState`, where event-time timers fire what no further event releases and then clear the state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadlake.functions.placing import together
from threadlake.streaming.assembly import SCHEMA, _new, _rows, advance

FLUSHES = "key long, fired_at long, first_at long, n long, last_id long"
ADMISSIONS = "key long, at long, why string, n long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Flush:
    """Events of a key since the last flush: all go `quiet` after the last one, but no later than `longest` after the first."""

    def __init__(self, quiet: int, longest: int):
        self.quiet, self.longest, self.clear = quiet, longest, (0, 0, 0, 0)

    def due(self, state: tuple) -> int | None:
        first, last, n, _ = state
        return min(last + self.quiet, max(last, first + self.longest)) if n else None

    def fired(self, key: int, state: tuple) -> tuple[tuple | None, tuple]:
        first, _, n, last_id = state
        return (key, self.due(state), first, n, last_id), self.clear

    def seen(self, key: int, state: tuple, at: int, id_: int) -> tuple[tuple | None, tuple]:
        first, _, n, _ = state
        return None, (first if n else at, at, n + 1, id_)


class _Admission:
    """Captures of a key: one is admitted at once, unless the last admission was less than `cooldown` ago; then it waits for a
    check `cooldown` + `more` later, which is put off as long again while the last capture is less than `quiet` ago, up to
    `most` times or until `many` captures wait."""

    def __init__(self, cooldown: int, more: int, quiet: int, most: int = 5, many: int = 50):
        self.cooldown, self.wait, self.quiet, self.most, self.many, self.clear = cooldown, cooldown + more, quiet, most, many, (-1, -1, 0, 0, 0)

    def due(self, state: tuple) -> int | None:
        return state[1] if state[1] >= 0 else None

    def fired(self, key: int, state: tuple) -> tuple[tuple | None, tuple]:
        admitted, check, last, put_off, n = state
        forced = put_off >= self.most or n >= self.many
        if check - last < self.quiet and not forced:
            return None, (admitted, check + self.wait, last, put_off + 1, n)
        return (key, check, "forced" if check - last < self.quiet else "deferred", n), (check, -1, last, 0, 0)

    def seen(self, key: int, state: tuple, at: int, _: int) -> tuple[tuple | None, tuple]:
        admitted, check, last, put_off, n = state
        if check >= 0:
            return None, (admitted, check, at, put_off, n + 1)
        if admitted < 0 or at - admitted >= self.cooldown:
            return (key, at, "at once", n + 1), (at, -1, at, 0, 0)
        return None, (admitted, at + self.wait, at, 0, n + 1)


def _in_order(events: DataFrame, rule, schema: str) -> DataFrame:
    """What rule does with the events (key, at, id) of each key, in order; after the last one everything falls due."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, rule.clear, []

        def until(at: int | None) -> None:
            nonlocal state
            while (due := rule.due(state)) is not None and (at is None or due <= at):
                row, state = rule.fired(key, state)
                if row:
                    out.append(row)

        def taken() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string() if n == "why" else pa.int64()) for j, n in enumerate(names)], names)

        for batch in batches:
            for k, at, id_ in zip(*(batch.column(j).to_pylist() for j in range(3))):
                if k != key:
                    until(None)
                    key, state = k, rule.clear
                until(at)
                row, state = rule.seen(key, state, at, id_)
                if row:
                    out.append(row)
            yield taken()
        until(None)
        yield taken()

    rows = together(events.select("key", "at", "id").filter("key IS NOT NULL AND at IS NOT NULL"), ["key"], "at", "id")
    return rows.mapInArrow(run, schema)


class _Timed(StatefulProcessor):
    """A rule over a stream of (key, at seconds, id): what falls due before the next event of the key, or by the watermark."""

    def __init__(self, rule, names: list[str]):
        self.rule, self.names = rule, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string")

    def _get(self) -> tuple:
        return tuple(json.loads(self.held.get()[0])) if self.held.exists() else self.rule.clear

    def _put(self, state: tuple) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = self.rule.due(state)
        if due is not None:
            self.handle.registerTimer(due * 1000)
        elif state == self.rule.clear:
            return self.held.clear()
        self.held.update((json.dumps(state),))

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.names)

    def handleInputRows(self, key, rows, timerValues):
        state, out = self._get(), []
        for at, id_ in pd.concat(list(rows)).sort_values(["second", "id"])[["second", "id"]].itertuples(index=False):
            while (due := self.rule.due(state)) is not None and due <= at:
                row, state = self.rule.fired(key[0], state)
                out += [row] if row else []
            row, state = self.rule.seen(key[0], state, int(at), int(id_))
            out += [row] if row else []
        self._put(state)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, out = self._get(), []
        while (due := self.rule.due(state)) is not None and due * 1000 <= timerValues.getCurrentWatermarkInMs():
            row, state = self.rule.fired(key[0], state)
            out += [row] if row else []
        self._put(state)
        yield from self._frame(out)

    def close(self) -> None:
        pass


def _timed(events: DataFrame, rule, schema: str) -> DataFrame:
    rows = events.selectExpr("key", "at", "unix_seconds(at) AS second", "id").withWatermark("at", "0 seconds")
    return rows.groupBy("key").transformWithStateInPandas(_Timed(rule, [c.split()[0] for c in schema.split(", ")]), schema, "append", "eventTime")


def flushes(events: DataFrame, quiet: int, longest: int) -> DataFrame:
    """(key, fired_at, first_at, n, last_id) of events (key, at, id): seconds as whole numbers in a batch, at as a timestamp on a
    stream, whose session needs the RocksDB state store. Rows with a null key or time are left out."""
    rule = _Flush(quiet, longest)
    return _timed(events, rule, FLUSHES) if events.isStreaming else _in_order(events, rule, FLUSHES)


def admissions(captures: DataFrame, cooldown: int = 10, more: int = 1, quiet: int = 8) -> DataFrame:
    """(key, at, why, n) of captures (key, at, id), as `flushes` takes them: when each key's captures are admitted and how many."""
    rule = _Admission(cooldown, more, quiet)
    return _timed(captures, rule, ADMISSIONS) if captures.isStreaming else _in_order(captures, rule, ADMISSIONS)


class _Streams(StatefulProcessor):
    """Response streams whose messages are handed out when no line came for `idle` seconds; then nothing of them is held."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "message_id string")
        self.messages = handle.getMapState("messages", "message_id string", "role string, content string")

    def handleInputRows(self, key, rows, timerValues):
        state = _new()
        state["at"] = self.at.get()[0] if self.at.exists() else None
        state["messages"] = {k[0]: [v[0], v[1]] for k, v in self.messages.iterator()}
        new, last = pd.concat(list(rows)).sort_values("line_number"), 0
        for line, second in new[["line", "second"]].itertuples(index=False):
            advance(state, line)
            last = max(last, int(second))
        self.at.update((state["at"],))
        for message_id, message in state["messages"].items():
            self.messages.updateValue((message_id,), tuple(message))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.idle) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rows = _rows(key[0], {"messages": {k[0]: (v[0], v[1]) for k, v in self.messages.iterator()}})
        self.at.clear()
        self.messages.clear()
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def ended_streams(lines: DataFrame, idle: int) -> DataFrame:
    """`assembly.assemble` over a stream of lines (stream_id, at, line_number, line): each stream's messages once, when it ends."""
    rows = lines.selectExpr("stream_id", "at", "unix_seconds(at) AS second", "line_number", "line").withWatermark("at", "0 seconds")
    return rows.groupBy("stream_id").transformWithStateInPandas(_Streams(idle), SCHEMA, "append", "eventTime")
