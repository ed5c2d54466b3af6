"""Answers from token streams and framed chunks, and the request that each answers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from threadlake.functions.placing import together

DEPTH, LEAST = 12, 10
_NAME, _NUMBER = re.compile(r"[a-zA-Z0-9_-]+\Z"), re.compile(r"[\d.eE+-]+\Z")
ANSWERS = "stream_id long, content string"


def deepest_text(node, depth: int = 0) -> str:
    """The longest text in a JSON tree, the first of equal ones: a string of LEAST characters or more with a space, no name and
    no number; the parts of a first candidate come before all else in its object; below DEPTH nothing is looked for."""
    if depth > DEPTH or node is None:
        return ""
    if isinstance(node, str):
        return node if len(node) >= LEAST and " " in node and not _NAME.match(node) and not _NUMBER.match(node) else ""
    if isinstance(node, dict):
        candidates = node.get("candidates")
        first = candidates[0] if isinstance(candidates, list) and candidates else None
        content = first.get("content") if isinstance(first, dict) else None
        parts = content.get("parts") if isinstance(content, dict) else None
        joined = "".join(str(p.get("text") or "") for p in parts if isinstance(p, dict)) if isinstance(parts, list) else ""
        if joined.strip():
            return joined
        node = list(node.values())
    best = ""
    for child in node if isinstance(node, list) else []:
        found = deepest_text(child, depth + 1)
        best = found if len(found) > len(best) else best
    return best


@F.arrow_udf(StringType())
def json_text(bodies: pa.Array) -> pa.Array:
    """`deepest_text` of JSON texts; empty for what is no JSON, null for null."""

    def one(body: str | None) -> str | None:
        try:
            return None if body is None else deepest_text(json.loads(body))
        except (ValueError, RecursionError):
            return ""

    return pa.array([one(b) for b in bodies.to_pylist()], pa.string())


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def _choice(event: dict) -> str | None:
    choices = event.get("choices")
    first = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
    for held in (first.get("delta"), first.get("message")):
        if isinstance(held, dict) and isinstance(held.get("content"), str):
            return held["content"]
    return None


def piece(event: dict) -> tuple[str, str]:
    """(piece, whole answer) of an event: a delta, a chunk, or the first token that one of its fields holds."""
    answer = _text(event.get("answer"))
    for field in ("chunk", "text"):
        if isinstance(event.get(field), str):
            return event[field], answer
    if (found := _choice(event)) is not None:
        return found, answer
    result = event.get("result") if isinstance(event.get("result"), dict) else {}
    response = result.get("response") if isinstance(result.get("response"), dict) else {}
    tokens = (event.get("token"), event.get("content"), response.get("token"), response.get("message"), result.get("token"))
    return next((t for t in map(_text, tokens) if t), ""), answer


def answers(lines: DataFrame) -> DataFrame:
    """(stream_id, content) of lines (stream_id, line_number, line): the longest whole answer of a stream, or else its pieces in
    order. Lines are JSON, with 'data:' before or not; an array, a frame of chunks, gives its deepest text. Lines that only
    hold a frame's length, ends and broken JSON give nothing; so do streams without content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, pieces, whole = None, [], ""
        done: list[tuple[int, str]] = []

        def close() -> None:
            text = (whole or "".join(pieces)).strip()
            if text:
                done.append((stream, text))

        def out() -> pa.RecordBatch:
            rows, done[:] = list(done), []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["stream_id", "content"])

        for batch in batches:
            for s, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if s != stream:
                    close()
                    stream, pieces, whole = s, [], ""
                payload = (line or "").strip().removeprefix(")]}'").strip()
                payload = payload[5:].strip() if payload.startswith("data:") else payload
                try:
                    event = json.loads(payload) if payload and payload != "[DONE]" else None
                except ValueError:
                    continue
                if isinstance(event, list):
                    pieces.append(deepest_text(event))
                elif isinstance(event, dict):
                    more, answer = piece(event)
                    pieces.append(more)
                    whole = answer if len(answer) > len(whole) else whole
            yield out()
        close()
        yield out()

    rows = together(lines.select("stream_id", "line_number", "line").filter("stream_id IS NOT NULL"), ["stream_id"], "line_number")
    return rows.mapInArrow(run, ANSWERS)


def prompt(body: Column) -> Column:
    """The last user message of a request's JSON, its parts of text on lines, or else its message or query; null without one."""
    said = F.from_json(body, "messages array<struct<role string, content string>>")["messages"]
    parts = lambda c: F.from_json(c, "array<struct<type string, text string>>")
    text = lambda c: F.when(c.startswith("["), F.array_join(F.transform(F.filter(parts(c), lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")).otherwise(c)
    asked = F.filter(F.transform(F.filter(said, lambda m: m["role"] == "user"), lambda m: F.trim(text(m["content"]))), lambda t: t != "")
    single = [F.nullif(F.trim(F.get_json_object(body, f"$.{k}")), F.lit("")) for k in ("message", "query", "q")]
    return F.coalesce(F.try_element_at(asked, F.lit(-1)), *single)


def exchanges(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """(stream_id, place, role, content): each stream's request (stream_id, body) and its answer."""
    asked = requests.select("stream_id", F.lit(0).alias("place"), F.lit("user").alias("role"), prompt(F.col("body")).alias("content")).filter("content IS NOT NULL")
    return asked.unionByName(answers(lines).select("stream_id", F.lit(1).alias("place"), F.lit("assistant").alias("role"), "content"))
