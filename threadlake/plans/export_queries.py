"""Exports, exchanges of requests and answers, deep JSON texts, and kinds of files, each with its own oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlake.operators import exports
from threadlake.plans.summary_queries import _M, dialogues
from threadlake.sources import samples
from threadlake.sources.tables import table
from threadlake.streaming import answers

PIECE = 30
INDENT = "Intro.\n    def load(x):\n        y = x\n    print(y)\nThat is all."


def _sessions_and_messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = dialogues(spark, sf_dir).drop("conv_id", "turn").unionByName(samples.frame(spark, samples.MESSAGES, samples.MESSAGE_COLUMNS))
    m = m.withColumn("content", F.when(F.col("message_index") % 7 == 3, F.lit(INDENT)).otherwise(F.coalesce("content", F.lit(""))))
    title = F.substring(F.min_by("content", "message_index"), 1, 60)
    sessions = m.groupBy("session_id").agg(title.alias("title")).withColumn("platform", F.concat(F.lit("p"), (F.col("session_id") % 6).cast("string"))).withColumn("day", F.lit("2024-01-31"))
    return sessions, m


def exported_files(spark, sf_dir):
    return exports.exported(*_sessions_and_messages(spark, sf_dir)).filter("format <> 'json'").select("session_id", "name", "format", F.md5("text").alias("md5"))


def exported_json(spark, sf_dir):
    """What is in the exported JSON, read back."""
    texts = exports.exported(*_sessions_and_messages(spark, sf_dir)).filter("format = 'json'")
    back = F.from_json("text", "session_id long, title string, messages array<struct<role string, content string>>")
    return texts.select(back.alias("s")).select("s.session_id", F.posexplode("s.messages").alias("place", "m")).select("session_id", "place", "m.role", F.md5("m.content").alias("md5"))


def file_languages(spark, sf_dir):
    names = " ".join(e for x in exports.ENDINGS.values() for e in x.split()).split() + ["env", "zz", ""]
    ending = F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", exports.file_language(F.concat(F.lit("dir.x/f"), F.col("page_id").cast("string"), F.when(ending == "", "").otherwise(F.concat(F.lit("."), ending)))).alias("language"))


def page_probes(spark, sf_dir):
    """Pages' sources as scripts."""
    html = F.col("html")
    code = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("(function walk() {"), html)).when(F.col("page_id") % 5 == 1, F.concat(F.lit("x.querySelectorAll('a').forEach(y)"), html)).when(F.col("page_id") % 5 == 2, F.concat(F.lit("console.log('diagnostic ', 1);"), html)).otherwise(html)
    return table(spark, sf_dir, "pages").select("page_id", exports.is_probe(code).alias("probe"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def answered_requests(spark, sf_dir):
    """Every turn as a request and as an answer to itself, in the forms that requests and answers have."""
    t = _turns(spark, sf_dir)
    kind = F.pmod("stream_id", F.lit(4))
    said = lambda c: F.array(F.struct(F.lit("user").alias("role"), F.lit("earlier").alias("content")), F.struct(F.lit("user").alias("role"), c.alias("content")))
    parts = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit("see").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")))
    body = F.when(kind == 0, F.to_json(F.struct(said(F.col("text")).alias("messages")))).when(kind == 1, F.to_json(F.struct(parts.alias("messages")))).when(kind == 2, F.to_json(F.struct(F.col("text").alias("query")))).otherwise(F.lit("{broken"))
    rows = t.filter("text <> ''").select("*", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(PIECE))).alias("j", "start")).withColumn("piece", F.substring("text", F.col("start") + 1, F.lit(PIECE)))
    final = F.col("start") + PIECE >= F.length("text")
    token = F.to_json(F.struct(F.struct(F.struct(F.col("piece").alias("token")).alias("response")).alias("result")))
    chunk = F.when(final, F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("x").alias("chunk"), F.col("text").alias("answer"))))).otherwise(F.to_json(F.struct(F.col("piece").alias("chunk"))))
    delta = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("piece").alias("content")).alias("delta"))).alias("choices"))))
    frame = F.to_json(F.array(F.array(F.lit("id"), F.when(F.length(F.trim("piece")) >= 10, F.col("piece")).otherwise("no"))))
    lines = rows.select("stream_id", F.col("j").cast("long").alias("line_number"), F.when(kind == 0, token).when(kind == 1, chunk).when(kind == 2, delta).otherwise(frame).alias("line"))
    return answers.exchanges(t.select("stream_id", body.alias("body")), lines).withColumn("content", F.md5("content"))


def deepest_texts(spark, sf_dir):
    """Each conversation as a JSON tree of arrays and objects: its texts lie at depths up to six."""
    t = _turns(spark, sf_dir).withColumn("leaf", F.struct(F.col("turn"), F.lit("name_only_of_it").alias("id"), F.array(F.array(F.struct(F.col("text").alias("deep"), F.lit("12345678901").alias("number")))).alias("tree")))
    trees = t.groupBy("conv_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "leaf"))), lambda x: x["leaf"]).alias("data"))).alias("body"))
    return trees.select("conv_id", F.md5(answers.json_text(F.col("body"))).alias("md5"))


_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_FILES = f"""{_M}, x AS (SELECT session_id, message_index AS at_i, role, CASE WHEN message_index % 7 = 3 THEN 'Intro.' || chr(10) || '    def load(x):' || chr(10) || '        y = x' || chr(10) || '    print(y)' || chr(10) || 'That is all.' ELSE coalesce(content, '') END AS c FROM a),
    y AS (SELECT *, CASE WHEN starts_with(c, 'Intro.' || chr(10) || '    def') THEN 'Intro.' || chr(10) || chr(10) || '```python' || chr(10) || 'def load(x):' || chr(10) || '    y = x' || chr(10) || 'print(y)' || chr(10) || '```' || chr(10) || chr(10) || 'That is all.' ELSE c END AS shown,
        row_number() OVER (PARTITION BY session_id ORDER BY at_i) AS i, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS who FROM x),
    s AS (SELECT session_id, count(*) AS n, arg_min(c, at_i)[:60] AS title, 'p' || session_id % 6 AS p, string_agg('## Message ' || i || chr(10) || chr(10) || '**Role:** ' || who || chr(10) || chr(10) || shown || chr(10) || chr(10) || '---', chr(10) || chr(10) ORDER BY i) AS body,
        string_agg(i || '. [Message ' || i || ' — ' || who || '](#message-' || i || ') — ' || trim(regexp_replace(c[:50], '[\\n\\r]+', ' ', 'g')) || '…', chr(10) ORDER BY i) AS toc, string_agg(CASE WHEN role = 'user' THEN 'You:' ELSE 'AI:' END || chr(10) || c || chr(10), chr(10) ORDER BY i) AS plain,
        string_agg('"' || replace(role, '"', '""') || '","' || replace(c, '"', '""') || '"', chr(10) ORDER BY i) AS csv FROM y GROUP BY session_id),
    k AS (SELECT *, p || '_2024-01-31_' || coalesce(nullif(left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'session') AS stem FROM s)"""
_FRONT = """'---' || chr(10) || 'platform: ' || p || chr(10) || 'title: "' || replace(title, '"', '\\"') || '"' || chr(10) || 'date: 2024-01-31' || chr(10) || 'session_id: ' || session_id || chr(10) || 'message_count: ' || n || chr(10) || 'exported_by: threadlake' || chr(10) || '---' || chr(10) || chr(10)
    || '# ' || p || ' — ' || title || chr(10) || chr(10) || '> Exported on 2024-01-31 via threadlake' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN n >= 10 THEN '## Table of Contents' || chr(10) || chr(10) || toc || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || body"""
_NAMES = " ".join(e for x in exports.ENDINGS.values() for e in x.split()).split() + ["env", "zz", ""]
ORACLES = {
    "exported_files": f"""WITH {_FILES} SELECT session_id, stem || '.md' AS name, 'md' AS format, md5({_FRONT}) AS md5 FROM k UNION ALL SELECT session_id, stem || '.txt', 'txt', md5(p || ' | ' || title || ' | 2024-01-31' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || plain) FROM k
        UNION ALL SELECT session_id, stem || '.csv', 'csv', md5('role,content' || chr(10) || csv) FROM k""",
    "exported_json": f"WITH {_FILES} SELECT session_id, (i - 1)::INT AS place, role, md5(c) AS md5 FROM y",
    "file_languages": f"""WITH n AS (SELECT page_id, {_NAMES}[page_id % {len(_NAMES)} + 1] AS e FROM pages) SELECT page_id, CASE {' '.join(f"WHEN e IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in exports.ENDINGS.items())} ELSE 'plaintext' END AS language FROM n""",
    "page_probes": """WITH c AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '(function walk() {' || html WHEN 1 THEN 'x.querySelectorAll(''a'').forEach(y)' || html WHEN 2 THEN 'console.log(''diagnostic '', 1);' || html ELSE html END AS c FROM pages)
        SELECT page_id, length(c) >= 30 AND (regexp_matches(c, '(?i)console\\.log.*DIAGNOSTIC') OR regexp_matches(c, '(?i)DIAGNOSTIC.*DOM PROBE|DOM PROBE.*DIAGNOSTIC') OR regexp_matches(c, '^\\s*\\(function\\s+\\w+\\s*\\(\\s*\\)') OR (length(c) > 500 AND contains(c, 'querySelector') AND regexp_matches(c, '\\.forEach\\s*\\(|for\\s*\\('))) AS probe FROM c""",
    "answered_requests": f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, (conv_id * 1000 + turn) % 4 AS k, coalesce(text, '') AS x FROM conversations),
        p AS (SELECT id, k, unnest(list_transform(range(0, length(x), {PIECE}), lambda b: x[b + 1:b + {PIECE}])) AS piece, unnest(range(0, length(x), {PIECE})) AS b FROM t WHERE x <> ''),
        f AS (SELECT id, {_TRIM("string_agg(CASE WHEN length(trim(piece)) >= 10 AND contains(piece, ' ') THEN piece ELSE '' END, '' ORDER BY b)")} AS c FROM p WHERE k = 3 GROUP BY id)
        SELECT id AS stream_id, 0 AS place, 'user' AS role, md5(CASE k WHEN 1 THEN trim('see' || chr(10) || x) WHEN 0 THEN CASE WHEN trim(x) = '' THEN 'earlier' ELSE trim(x) END ELSE trim(x) END) AS content FROM t WHERE k < 2 OR k = 2 AND trim(x) <> ''
        UNION ALL SELECT id, 1, 'assistant', md5({_TRIM('x')}) FROM t WHERE k < 3 AND regexp_matches(x, '\\S') UNION ALL SELECT id, 1, 'assistant', md5(c) FROM f WHERE c <> ''""",
    "deepest_texts": """SELECT conv_id, md5(coalesce(first(text ORDER BY length(text) DESC, turn) FILTER (length(text) >= 10 AND contains(text, ' ')), '')) AS md5 FROM conversations GROUP BY conv_id""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
