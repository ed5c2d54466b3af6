"""Small authored dialogues and records for shapes that the driver's tables lack: fences, decisions, secrets, snapshots.

Each is a list of rows; `frame` gives the DataFrame and `values` the same rows as an SQL statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGE_COLUMNS = "session_id long, message_index long, role string, content string"
_LONG = " ".join(f"Sentence number {i} tells a little more about how the loader reads its input." for i in range(40))

MESSAGES = [
    (9000001, 0, "user", "Please help me, could you look at `load.py`? It fails with KeyError: 'id' when the file is empty."),
    (9000001, 1, "assistant", "Sure! The root cause is the missing header. We decided to read the schema first.\n```python\ndef load(path):\n    return open(path).read()\n```\nThis works because the schema names every column."),
    (9000001, 2, "user", "ok"),
    (9000001, 3, "assistant", "Understood, I'll do that."),
    (9000001, 4, "user", "Traceback (most recent call last):\n  at main (load.js:10:4)\nError: cannot read"),
    (9000001, 5, "assistant", "Fixed by closing the handle instead of waiting. See **bold words** and _under scored_ text.\n\n\n\n# Heading one\n- first bullet of the list\n2. second point of the list\n```\nplain block\n```\n```rust\nfn main() { let mut x = 1; }\n```"),
    (9000002, 0, "user", "You are a careful reviewer. Read every file and report what you find in the repository."),
    (9000002, 1, "assistant", _LONG),
    (9000002, 2, "user", "hello, can you just tell me whether GPT-4, Haiku, Opus, Llama and Mistral were compared to Qwen in a benchmark?"),
    (9000002, 3, "assistant", "I see what you mean by that question. The parser now keeps unclosed fences as text: ```js\nconst a = 1;"),
    (9000002, 4, "user", "We need to migrate the store to Parquet; the goal is one table per entity.\nAuthorization: Basic-abcdef and api_key = \"abcd1234abcd1234abcd\" and Bearer abc.def-ghi=="),
    (9000002, 5, "assistant", "<script>alert(1)</script> A link javascript: void and data:text/html and <iframe src=\"x\"> with onclick = go and [ SYSTEM ] plus <<< INSTRUCTIONS >>> & \"quotes\" 'single' ]]> end"),
    (9000003, 0, "user", "Export the report as a table."),
    (9000003, 1, "assistant", "import React from 'react'\n```tsx\nimport React from 'react'\nexport function View() { return null }\n```\n```go\npackage main\nfunc main() { fmt.Println(1) }\n```\n```sql\nselect 1\n```"),
    (9000003, 2, "user", ""),
    (9000003, 3, "assistant", None),
    (9000003, 4, "tool", "a role that no rule knows"),
    (9000004, 0, "user", "Certainly! absolutely. OK, the deadlock was patched by a hotfix; the job failed to start and HTTP 503 was returned while breaking the build for everyone on the team."),
    (9000004, 1, "user", "Two in a row from one side."),
]

SNAPSHOT_COLUMNS = "session_id long, source string, message_index long, role string, content string, updated_at long, name string"
#: Two captures of each session: what is stored and what comes in.
SNAPSHOTS = [
    (1, "stored", 0, "user", "first question about the loader", 10, "mine"), (1, "stored", 1, "assistant", "a short answer", 10, "mine"), (1, "stored", 2, "user", "and then", 10, "mine"),
    (1, "incoming", 0, "user", "first question about the loader", 20, ""), (1, "incoming", 1, "assistant", "a short answer", 20, ""),
    (2, "stored", 0, "user", "same start", 10, None), (2, "incoming", 0, "user", "same start", 30, "theirs"), (2, "incoming", 1, "assistant", "more came", 30, "theirs"),
    (3, "stored", 0, "user", "one thing", 50, "a"), (3, "stored", 1, "assistant", "one end", 50, "a"),
    (3, "incoming", 0, "user", "another thing", 60, "b"), (3, "incoming", 1, "assistant", "another end", 60, "b"),
    (4, "stored", 0, "user", "tie", 40, "x"), (4, "incoming", 0, "user", "tie", 40, "y"),
    (5, "stored", 0, "user", "only stored", 5, None),
    (6, "incoming", 0, "user", "only incoming", 6, None),
    (7, "stored", 0, "user", "again", 7, None), (7, "stored", 1, "user", "again", 7, None), (7, "stored", 2, "assistant", "the prefix of eighty characters is what counts here, and this one goes on and on - a", 7, None),
    (7, "incoming", 0, "user", "again", 8, None), (7, "incoming", 1, "assistant", "the prefix of  eighty characters is what counts here, and this one goes on and on - much longer", 8, None), (7, "incoming", 2, "assistant", "brand new", 8, None),
    (8, "stored", 0, "user", "equal start", 70, " p "), (8, "stored", 1, "assistant", "e", 70, " p "), (8, "incoming", 0, "user", "equal start", 90, "q"), (8, "incoming", 1, "assistant", "e", 90, "q"),
]

STREAM_COLUMNS = "stream_id long, line_number long, line string"
#: Lines of response streams: snapshots that grow, patches, deltas, broken JSON and end marks.
STREAMS = [
    (1, 0, 'data: {"message":{"id":"m1","author":{"role":"assistant"},"content":{"parts":["Hel"]}}}'),
    (1, 1, 'data: {"message":{"id":"m1","author":{"role":"assistant"},"content":{"parts":["Hello"," there"]}}}'),
    (1, 2, 'data: {"v":" friend","p":"/message/content/parts/0","o":"append"}'),
    (1, 3, 'data: {"v":"no","p":"/message/content/parts/0","o":"replace"}'),
    (1, 4, "data: {broken"),
    (1, 5, "data: [DONE]"),
    (2, 0, 'data: {"id":"c9","choices":[{"delta":{"role":"assistant","content":"One "}}]}'),
    (2, 1, 'data: {"id":"c9","choices":[{"delta":{"content":"two"}}]}'),
    (2, 2, 'data: {"id":"c9","choices":[{"delta":{}}]}'),
    (3, 0, 'data: {"message":{"id":"s","author":{"role":"system"},"content":{"parts":["hidden"]}}}'),
    (3, 1, 'data: {"message":{"id":"u","author":{"role":"user"},"content":{"text":"typed text"}}}'),
    (3, 2, 'event: ping'),
    (3, 3, 'data: {"message":{"id":"u","author":{"role":"user"},"content":{"text":"typed"}}}'),
    (4, 0, 'data: {"v":"lost","p":"/message/content/parts/0","o":"append"}'),
    (4, 1, 'data: {"message":{"id":"k","author":{"role":"assistant"},"content":{"parts":[]}}}'),
    (4, 2, 'data: {"v":"a much longer replacement","p":"/message/content/parts/0","o":"replace"}'),
    (4, 3, 'data: {"v":"!","p":"/message/metadata","o":"append"}'),
    (5, 0, "data: [DONE]"),
    (6, 0, 'data: {"type":"message_start","message":{"id":"b1","role":"assistant"}}'),
    (6, 1, 'data: {"type":"content_block_delta","delta":{"text":"Block "}}'),
    (6, 2, 'data: {"type":"content_block_delta","delta":{"text":"text"}}'),
    (7, 0, '42["progress",{"id":"p1","status":"pending","answer":"half"}]'),
    (7, 1, '42/ns,["answer",{"id":"p1","status":"completed","answer":"The whole answer"}]'),
    (7, 2, "42[broken"),
]


def frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def values(rows: list[tuple], columns: str) -> str:
    """SELECT .. FROM (VALUES ..) in standard SQL; the columns' types come from the schema string."""
    sql_type = {"long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}
    pairs = [c.split() for c in columns.split(", ")]
    cell = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {sql_type[t]}) AS {n}' for n, t in pairs)} FROM (VALUES {body}) v({', '.join(n for n, _ in pairs)})"
