"""Messages from the lines of response streams, in batches and as a stream with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadlake.functions.placing import together

SCHEMA = "stream_id long, message_id string, role string, content string"


def _text(content) -> str:
    """A message's text: its parts that are strings, or its text."""
    if not isinstance(content, dict):
        return content if isinstance(content, str) else ""
    parts = content.get("parts")
    return "".join(p for p in parts if isinstance(p, str)) if isinstance(parts, list) else str(content.get("text") or "")


def _snapshot(state: dict, message: dict) -> None:
    state["at"] = str(message.get("id") or "_")
    role = (message.get("author") or {}).get("role")
    if role in ("user", "assistant"):
        text, before = _text(message.get("content")), state["messages"].get(state["at"], [role, ""])[1]
        state["messages"][state["at"]] = [role, text if len(text) >= len(before) else before]


def _patch(state: dict, event: dict) -> None:
    held = state["messages"].get(state["at"])
    if held and "/content/" in event["p"]:
        longer = event["v"] if len(event["v"]) > len(held[1]) or not held[1] else held[1]
        held[1] = held[1] + event["v"] if event.get("o") == "append" else longer


def _append(state: dict, at: str, role: str, text: str) -> None:
    state["at"] = at
    held = state["messages"].setdefault(at, [role, ""])
    held[1] += text


def _packet(state: dict, line: str) -> None:
    """A socket packet of kind 42, maybe with a namespace: [event, payload]; only final payloads count."""
    body = line[2:]
    event = json.loads(body.partition(",")[2] if body.startswith("/") else body)
    payload = event[1] if isinstance(event, list) and len(event) > 1 else None
    if isinstance(payload, dict) and (payload.get("status") in ("completed", "done", "final") or payload.get("final") is True):
        state["messages"][str(payload.get("id") or "_")] = ["assistant", _text(payload.get("answer") or payload.get("text"))]


def advance(state: dict, line: str | None) -> None:
    """One line's effect on state: {'at': current message id, 'messages': {id: [role, content]}}.

    A snapshot replaces a shorter content; a patch to the content of the current message appends, or replaces a shorter
    one; a delta appends, whether of choices or of content blocks after a message's start; a final packet of a socket is
    a whole answer. Other roles than user and assistant only change the current message, and broken lines nothing."""
    line = (line or "").strip()
    try:
        if line.startswith("42"):
            return _packet(state, line)
        payload = line[5:].strip() if line.startswith("data:") else ""
        event = json.loads(payload) if payload and payload != "[DONE]" else None
    except ValueError:
        return
    if not isinstance(event, dict):
        return
    message, delta = event.get("message"), event.get("delta")
    if event.get("type") == "message_start" and isinstance(message, dict):
        _append(state, str(message.get("id") or "_"), str(message.get("role") or "assistant"), "")
    elif event.get("type") == "content_block_delta" and isinstance(delta, dict):
        _append(state, state["at"] or "_", "assistant", str(delta.get("text") or ""))
    elif isinstance(message, dict):
        _snapshot(state, message)
    elif isinstance(event.get("v"), str) and isinstance(event.get("p"), str):
        _patch(state, event)
    elif isinstance(event.get("choices"), list) and event["choices"]:
        delta = event["choices"][0].get("delta") or {}
        if delta.get("content"):
            _append(state, str(event.get("id") or "legacy"), str(delta.get("role") or "assistant"), str(delta["content"]))


def _new() -> dict:
    return {"at": None, "messages": {}}


def _rows(stream: int, state: dict) -> list[tuple]:
    return [(stream, i, role, text.strip()) for i, (role, text) in state["messages"].items() if text.strip()]


def assemble(lines: DataFrame) -> DataFrame:
    """(stream_id, message_id, role, content) of lines (stream_id, line_number, line). Lines pass through tasks in order,
    with one stream's messages in hand; streams that give no message give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, _new()
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string()))], ["stream_id", "message_id", "role", "content"])
        for batch in batches:
            done = []
            for stream, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if stream != held:
                    done += _rows(held, state)
                    held, state = stream, _new()
                advance(state, line)
            if done:
                yield as_batch(done)
        if rest := _rows(held, state):
            yield as_batch(rest)

    rows = together(lines.select("stream_id", "line_number", "line").filter("stream_id IS NOT NULL"), ["stream_id"], "line_number")
    return rows.mapInArrow(run, SCHEMA)


HISTORY = "mapping map<string, struct<message: struct<id: string, author: struct<role: string>, content: struct<parts: array<string>>, create_time: double>>>"


def history_messages(histories: DataFrame) -> DataFrame:
    """(history_id, place, role, content) of histories (history_id, body): JSON trees of messages, in order of time; JVM only.
    Malformed bodies give no rows."""
    node = F.explode(F.map_values(F.from_json("body", HISTORY)["mapping"])).alias("n")
    rows = histories.select("history_id", node).select("history_id", "n.message.*").filter(F.col("author.role").isin("user", "assistant"))
    content = F.trim(F.array_join("content.parts", ""))
    place = F.row_number().over(Window.partitionBy("history_id").orderBy("create_time", "id")) - 1
    return rows.filter(content != "").select("history_id", place.cast("bigint").alias("place"), F.col("author.role").alias("role"), content.alias("content"))


def assemble_stream(lines: DataFrame) -> DataFrame:
    """The same over a streaming DataFrame: after each micro-batch the messages, as known by then, of the streams in it.
    Lines of one stream must come in order from one micro-batch to the next."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else _new()
        new = pd.concat(list(parts)).sort_values("line_number")  # what one micro-batch brings for one stream
        for line in new["line"]:
            advance(state, line)
        group.update((json.dumps(state),))
        yield pd.DataFrame(_rows(key[0], state), columns=["stream_id", "message_id", "role", "content"])

    return lines.groupBy("stream_id").applyInPandasWithState(run, SCHEMA, "state string", "update", GroupStateTimeout.NoTimeout)
