"""Contexts, transcripts and summaries of dialogues, each with an oracle written from its rule.

The dialogues are the conversations, put together to sessions of under 30, of 30 to 100 and of over 100 messages, with
phrases and code that the rules look for before and after each text; and the authored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlake.functions.vectors import cosine
from threadlake.operators import summaries as S
from threadlake.plans.operator_oracles import _has
from threadlake.sources import samples
from threadlake.sources.tables import table

OPENINGS = [
    "We decided to keep it.", "Please fix the loader for me,", "Here's the change:", "The root cause was a stale handle.", "ok", "Fixed it by closing the file!", "You should replace the old cache with a table.", "TODO: the next step is to test it.",
    "I've updated the schema. It works now.", "TypeError: x is undefined", "This works because the config is read first.", "say hi", "The fix is to cut it off-by-one.", "We need to build the endpoint; note that it depends on the port.", "That error is back, as mentioned above.",
    "<context_migration>old</context_migration>", "Let's use two tables instead of one for this.", "It turned out to be a race condition. HTTP 503 was logged.", "Sure!", "You are a reviewer.", "Rather than wait, we went with a queue.", "It is failing. The selector is missing.",
    "GPT-4, Haiku, Opus, Llama and Qwen in a benchmark:",
]
ENDINGS = [
    "", "Not yet done.\n\nAnother paragraph follows. And one more sentence! Is it enough?", "```python\n# src/load.py\nimport pandas\ndef load(x):\n    return x\n```", "```\nplain words\n```", "Look:\n```\nconst a = 1;\nlet b = react(a);\n```\nand\n```tsx\nexport const View = 1\n```",
    "We will use it here.", "```rust\nfn main() { cargo }\n```\nThe deadlock was resolved by a retry.", "It must not fail.\nThe version is pinned\nStill need a review", "```sql\n-- db/main.sql\nselect 1 from postgres\n```", "The approach is simple: one pass, then a join on the key.", "```text\n" + "a long plain note " * 14 + "\n```",
]
CATEGORY_VECTORS = {"goals": 0, "decisions": 1, "bugs": 2, "context": 3, "questions": 4}
BUDGET = 600


def _session(conv: str, div: str) -> str:
    return f"CASE WHEN {conv} % 4 = 0 THEN {conv} WHEN {conv} % 4 = 1 THEN 10000000 + {div.format(conv, 40)} ELSE 20000000 + {div.format(conv, 80)} END"


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, a, b: F.element_at(F.array(*map(F.lit, names)), ((F.col("conv_id") * a + F.col("turn") * b) % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(
        F.expr(_session("conv_id", "{} div {}")).alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_index"), "role",
        F.concat(pick(OPENINGS, 31, 7), F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\n"), pick(ENDINGS, 17, 5)).alias("content"), "conv_id", "turn",
    )
    return rows


def _all(spark, sf_dir):
    return dialogues(spark, sf_dir).drop("conv_id", "turn").unionByName(samples.frame(spark, samples.MESSAGES, samples.MESSAGE_COLUMNS))


def _digest(rows):
    return rows.withColumn("text", F.md5("text"))


def session_contexts(spark, sf_dir):
    return _digest(S.contexts(_all(spark, sf_dir)))


def session_summaries(spark, sf_dir):
    return _digest(S.summaries(_all(spark, sf_dir)))


def task_summaries(spark, sf_dir):
    return _digest(S.summaries(_all(spark, sf_dir), "replace the cache with postgres").filter("section IN ('decisions', 'code')"))


def scored_messages(spark, sf_dir):
    return S.message_scores(_all(spark, sf_dir)).select("session_id", "message_index", "i", "score")


def session_transcripts(spark, sf_dir):
    return S.transcripts(_all(spark, sf_dir)).select("session_id", "message_index", "role", F.md5("content").alias("md5"))


def long_transcripts(spark, sf_dir):
    return S.transcript_blocks(S.transcripts(_all(spark, sf_dir))).select("session_id", "message_index", "block", F.md5("text").alias("md5"))


def _category_scores(spark, sf_dir):
    """Cosines of a message's vector, that of its number, with five vectors; a later message counts up to a fifth more."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    m = dialogues(spark, sf_dir).select("session_id", "message_index", (F.col("conv_id") * 5 + F.col("turn")).alias("vec_id"))
    wanted = e.filter("vec_id < 5").groupBy().agg(*(F.max(F.when(F.col("vec_id") == v, F.col("embedding"))).alias(c) for c, v in CATEGORY_VECTORS.items()))  # one row
    met = m.join(e, "vec_id").crossJoin(F.broadcast(wanted))
    score = F.create_map(*(x for c in CATEGORY_VECTORS for x in (F.lit(c), F.round(cosine(F.col(c), F.col("embedding")), 6))))
    return met.select("session_id", "message_index", score.alias("scores"), (1 + F.col("message_index") % 1000 / 40).alias("boost"))


def scored_summaries(spark, sf_dir):
    return _digest(S.scored_summaries(dialogues(spark, sf_dir).drop("conv_id", "turn"), _category_scores(spark, sf_dir), BUDGET))


def _list(names: list[str]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for n in names) + "]"


def _any(text: str, patterns: list[str]) -> str:
    return _has("|".join(f"(?:{p})" for p in patterns).replace("'", "''"), text=text)


_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_ERROR = _any("content", [r"\b(Traceback|TypeError|ValueError|ReferenceError|SyntaxError|RuntimeError|AttributeError|NameError|ImportError|KeyError|IndexError|ZeroDivisionError)\b", r"\bat\s+\w[\w.]*\s+\([^)]+:\d+:\d+\)", r"\bError:\s+\S", r"Exception\s+in\s+thread"])
_CAUSE = r"\broot cause\b|\bcaused by\b|\bfixed by\b|\bresolved by\b"
_WEIGHTS = lambda *scores: "round(least(10e0, " + " + ".join(f"CASE WHEN {_has(p, h, 's')} THEN {w} ELSE 0 END" for p, h, w in scores) + " + least(1e0, length(s) / 400e0)), 6)"
_DECISION = _WEIGHTS((_CAUSE, "i", 3), (r"\bdecided\b|\bchose\b|\bopted for\b|\bwent with\b|\bgoing with\b", "i", 2), (r"\binstead of\b|\brather than\b|\bswitching to\b|\bmigrating to\b", "i", 2), (r"`[^`]+`|\b[A-Z][a-zA-Z]+Error\b", "c", 2), (r"\bthis works because\b|\bthe reason\b|\bbecause of\b", "i", 1))
_BUG = _WEIGHTS((_CAUSE, "i", 4), (r"\b[A-Z][a-zA-Z]+(?:Error|Exception)\b", "c", 3), (r"\brace condition\b|\bnull pointer\b|\bmemory leak\b|\bdeadlock\b", "i", 3), (r"\bworkaround\b|\bhotfix\b|\bpatched\b", "i", 1), (r"\bbreak(?:ing|s)\b|\bfail(?:ing|ed|s)\b", "i", 2), (r"\bfailed to\b|\bnot (?:found|matching|detecting)\b", "i", 2), (r"\bHTTP [45]\d\d\b", "i", 2))
_DIALOGUES = f"""d AS (SELECT {_session('conv_id', '{} // {}')} AS session_id, conv_id * 1000 + turn AS message_index, role,
    {_list(OPENINGS)}[(conv_id * 31 + turn * 7) % {len(OPENINGS)} + 1] || ' ' || coalesce(text, '') || chr(10) || {_list(ENDINGS)}[(conv_id * 17 + turn * 5) % {len(ENDINGS)} + 1] AS content, conv_id, turn FROM conversations)"""
_M = f"""{_DIALOGUES}, a AS (SELECT session_id, message_index, role, content FROM d UNION ALL {samples.values(samples.MESSAGES, samples.MESSAGE_COLUMNS)}),
    m AS (SELECT session_id, message_index AS at_i, role, coalesce(content, '') AS content, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY message_index) - 1 AS i FROM a)"""
_FENCES = "regexp_extract_all(content, '(?s)```[\\w-]*[ \\t]*\\n.*?```')"
_CODE = rf"""x AS (SELECT session_id, at_i, content, unnest({_FENCES}) AS f, generate_subscripts({_FENCES}, 1) - 1 AS pos, {_FENCES} AS fs, string_split(regexp_replace(content, '```[\w-]*[ \t]*\n.*?```', chr(1), 'gs'), chr(1)) AS prose FROM m),
    y AS (SELECT *, regexp_extract(f, '^```([\w-]*)', 1) AS lang, regexp_replace(regexp_replace(f, '^```[\w-]*[ \t]*\n', ''), '```$', '') AS code, left(array_to_string(list_transform(range(0, pos + 1), lambda j: prose[j + 1] || CASE WHEN j < pos THEN fs[j + 1] ELSE '' END), ''), 1000000) AS ahead FROM x),
    z AS (SELECT *, {_TRIM("split_part(code, chr(10), 1)")} AS first_line, list_filter(list_transform(string_split_regex(right(ahead, 200), '[.!?\n]'), lambda s: {_TRIM('s')}), lambda s: length(s) > 10) AS said FROM y
        WHERE lang <> '' OR (len(list_filter(string_split(code, chr(10)), lambda s: {_TRIM('s')} <> '')) >= 2 AND {_has(S.SYNTAX, text='code')})),
    code AS (SELECT session_id, at_i, pos, CASE WHEN lang = '' THEN 'text' ELSE lang END AS language, coalesce(nullif(regexp_extract(first_line, '{S.PATHS[0]}', 1), ''), nullif(regexp_extract(first_line, '{S.PATHS[1]}', 1), '')) AS path, said[-1] AS context, code AS text FROM z)"""
_PROMPT = "(starts_with(content, 'You are a') OR starts_with(content, 'Read every file') OR starts_with(content, 'TASK —') OR starts_with(content, 'REQUIRED') OR coalesce(list_sum(list_transform(regexp_extract_all(content, '(?s)```.*?```'), lambda b: length(b))), 0) > 0.4e0 * length(content))"
_ABOUT_MODELS = rf"""(length(content) >= 30 AND ((len(list_distinct(list_transform(regexp_extract_all(content, '(?i)\b(?:GPT-?[34o]|Haiku|Sonnet|Opus|Llama|Mistral|Gemma|Qwen|Kimi|Copilot)\b'), lambda w: lower(w)))) >= 5
    AND {_has(r'(?i)\b(?:benchmark|leaderboard|eval(?:uation)?|ranking|compared? to|versus|vs|outperform|scores? higher)\b', text='content')}) OR {_has(r'(?i)\bSWE[- ]bench\b', text='content')}))"""
_CLAUSES = rf"""c AS (SELECT session_id, at_i, role, n, i, {_PROMPT} AS prompt, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT *, list_transform(string_split_regex(content, '[.!?\n]'), lambda s: {_TRIM('s')}) AS l FROM m))"""
_DONE = rf"""done AS (SELECT session_id, 'completed' AS section, at_i, 0 AS pos, {_TRIM("string_split_regex(" + _TRIM("split_part(content, chr(10), 1)") + ", '[.!?]')[1]")} AS text FROM m WHERE role = 'assistant' AND {_any('content', S.COMPLETED)})"""
_PENDING = lambda late: f"SELECT session_id, 'pending' AS section, at_i, pos, s AS text FROM c WHERE i >= n - {late} AND length(s) > 15 AND {_any('s', S.PENDING)}"
_ONCE = "QUALIFY row_number() OVER (PARTITION BY session_id, section, text ORDER BY {0}) = 1"
_NONE = "NULL AS language, NULL AS path, NULL AS context"
_ORDERED = "row_number() OVER (PARTITION BY session_id, section ORDER BY {0})"
_OUT = "session_id, section, place, md5(text) AS text, language, path, context"
_GOAL = "CASE WHEN length(t) > 600 THEN t[:600] || '…' ELSE t END"

_CONTEXTS = rf"""WITH {_M}, {_CODE}, {_CLAUSES}, {_DONE},
    items AS (SELECT * FROM done WHERE length(text) > 10 AND length(text) < 200 UNION ALL {_PENDING(20)}
        UNION ALL SELECT session_id, 'decisions', at_i, pos, '- ' || s FROM c WHERE role = 'assistant' AND NOT prompt AND length(s) > 20 AND {_any('s', S.DECISIONS)} AND NOT {_any('s', S.META)}
        UNION ALL SELECT session_id, 'facts', at_i, pos, '- ' || s FROM c WHERE NOT prompt AND length(s) > 20 AND {_any('s', S.FACTS)}),
    once AS (SELECT * FROM items {_ONCE.format('at_i, pos')}),
    placed AS (SELECT session_id, section, {_ORDERED.format('at_i, pos')} AS place, text, {_NONE} FROM once),
    newest AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_i DESC, pos) AS r FROM code),
    t AS (SELECT *, {_TRIM('content')} AS t FROM m), late AS (SELECT * FROM t WHERE length(t) >= 20 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY at_i DESC) <= 3),
    every AS (SELECT * FROM placed WHERE place <= CASE section WHEN 'completed' THEN 12 WHEN 'pending' THEN 10 ELSE 8 END
        UNION ALL SELECT session_id, 'code', row_number() OVER (PARTITION BY session_id ORDER BY r DESC), text, language, path, context FROM newest WHERE r <= 30
        UNION ALL SELECT session_id, 'goal', 1, coalesce(nullif(arg_min({_GOAL}, at_i) FILTER (role = 'user' AND NOT {_has(S.MIGRATION, text='t')}), ''), 'Not specified'), {_NONE} FROM t GROUP BY session_id
        UNION ALL SELECT s.session_id, 'focus', 1, coalesce(string_agg(CASE WHEN length(t) > 300 THEN t[:300] || '…' ELSE t END, chr(10) ORDER BY at_i), 'Not specified'), {_NONE} FROM (SELECT DISTINCT session_id FROM m) s LEFT JOIN late ON late.session_id = s.session_id GROUP BY s.session_id)
    SELECT {_OUT} FROM every"""

_FLAT = rf"regexp_replace(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')"
_SENTENCES = rf"""s AS (SELECT session_id, at_i, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT session_id, at_i, list_transform(string_split({_FLAT}, chr(1)), lambda x: {_TRIM('x')}) AS l FROM m WHERE role = 'assistant' AND NOT {_PROMPT} AND NOT {_ABOUT_MODELS})),
    told AS (SELECT session_id, 'decisions' AS section, at_i, pos, s AS text, {_DECISION} AS score FROM s WHERE length(s) > 20 AND {_any('s', S.MADE_DECISIONS)} AND NOT {_any('s', S.META)}
        UNION ALL SELECT session_id, 'bugs', at_i, pos, s, {_BUG} FROM s WHERE length(s) > 20 AND {_any('s', S.BUGS)})"""
_FOUND = "list_filter([" + ", ".join(["CASE lower(lang) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LANGUAGE_NAMES.items()) + " END"] + [f"CASE WHEN {_has(p, 'i', 'code')} THEN '{v}' END" for p, v in S.TECHNOLOGIES]) + "], lambda v: v IS NOT NULL)"
_SUMMARY = rf"""{_M}, {_CODE}, {_CLAUSES}, {_DONE}, {_SENTENCES},
    best AS (SELECT *, {_ORDERED.format('score DESC, at_i, pos')} AS place FROM (SELECT * FROM told WHERE length(text) < 400 {_ONCE.format('at_i, pos')})),
    items AS (SELECT * FROM done WHERE length(text) > 10 AND length(text) < 200 UNION ALL {_PENDING(40)}), placed AS (SELECT *, {_ORDERED.format('at_i, pos')} AS place FROM (SELECT * FROM items {_ONCE.format('at_i, pos')})),
    blocks AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY path IS NULL, at_i, pos) AS place FROM (SELECT * FROM code WHERE language <> 'text' OR path IS NOT NULL OR length(text) < 200 OR {_has(S.MORE_SYNTAX, text='text')}
        QUALIFY row_number() OVER (PARTITION BY session_id, coalesce(path, text[:60]) ORDER BY path IS NULL, at_i, pos) = 1)),
    named AS (SELECT session_id, 'tech' AS section, at_i, pos, unnest(l) AS text, generate_subscripts(l, 1) AS nth FROM (SELECT *, {_FOUND} AS l FROM y)),
    techs AS (SELECT session_id, section, {_ORDERED.format('at_i, pos, nth')} AS place, text FROM (SELECT * FROM named {_ONCE.format('at_i, pos, nth')})),
    e AS (SELECT *, i >= n - CASE WHEN n <= 30 THEN 30 WHEN n <= 80 THEN 12 ELSE 6 END AS late FROM m),
    tail AS (SELECT * FROM e WHERE late OR EXISTS (SELECT 1 FROM e o WHERE o.session_id = e.session_id AND o.late AND o.i - e.i IN (1, 2) AND {_any('o.content', S.DANGLING)})),
    u AS (SELECT session_id, at_i, content, {_TRIM('content')} AS t, row_number() OVER (PARTITION BY session_id ORDER BY at_i) - 1 AS k, count(*) OVER (PARTITION BY session_id) AS nu FROM m WHERE role = 'user'),
    g AS (SELECT session_id, k, content FROM u WHERE k IN (0, nu // 4, nu // 2, nu * 3 // 4, nu - 1) AND length(content) BETWEEN 31 AND 799 AND NOT starts_with(content, 'You are a') AND NOT starts_with(content, 'Read every file')),
    ids AS (SELECT DISTINCT session_id FROM m),
    parts AS (SELECT session_id, section, place, text, {_NONE} FROM best WHERE place <= CASE section WHEN 'decisions' THEN 20 ELSE 15 END
        UNION ALL SELECT session_id, section, place, text, {_NONE} FROM placed WHERE place <= CASE section WHEN 'completed' THEN 12 ELSE 10 END
        UNION ALL SELECT session_id, 'code', place, text, language, path, NULL FROM blocks WHERE place <= 15
        UNION ALL SELECT session_id, section, place, text, {_NONE} FROM techs WHERE place <= 12
        UNION ALL SELECT session_id, 'tail', row_number() OVER (PARTITION BY session_id ORDER BY at_i), content, NULL, NULL, role FROM tail
        UNION ALL SELECT session_id, 'goal', 1, coalesce((SELECT arg_min(t, at_i)[:600] FROM u WHERE u.session_id = ids.session_id AND NOT {_has(S.MIGRATION, text='t')} AND (length(t) >= 50 OR {_has(S.TECHNICAL, text='t')}) AND (length(t) >= 80 OR NOT {_has(S.TRIVIAL, text='t')})), 'Not specified'), {_NONE} FROM ids
        UNION ALL SELECT session_id, 'state', 1, coalesce(nullif(coalesce((SELECT arg_max(content, k) FROM g WHERE g.session_id = ids.session_id), (SELECT arg_max(content, k) FROM u WHERE u.session_id = ids.session_id))[:400], ''), 'Not specified'), {_NONE} FROM ids)"""
_SUMMARIES = rf"""WITH {_SUMMARY}, kept AS (SELECT session_id, sum(length(text)) AS k FROM parts WHERE section <> 'tech' GROUP BY session_id), whole AS (SELECT session_id, sum(length(content)) AS w FROM m GROUP BY session_id)
    SELECT {_OUT} FROM parts UNION ALL SELECT session_id, 'ratio', 1, md5((CASE WHEN w > 0 THEN greatest(0, floor((1 - k / w) * 100 + 0.5e0)::BIGINT) ELSE 0 END)::VARCHAR), {_NONE} FROM kept JOIN whole USING (session_id)"""
_WORDS = ["replace", "cache", "with", "postgres"]
_HIT = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in _WORDS) + ")"
_TASKS = rf"""WITH {_SUMMARY}, t AS (SELECT *, {_HIT('text')} AS hit, bool_or({_HIT('text')}) OVER (PARTITION BY session_id, section) AS any_hit FROM parts WHERE section = 'decisions')
    SELECT session_id, section, row_number() OVER (PARTITION BY session_id ORDER BY place) AS place, md5(text) AS text, language, path, context FROM t WHERE hit OR NOT any_hit
    UNION ALL SELECT session_id, section, row_number() OVER (PARTITION BY session_id ORDER BY NOT ({_HIT('text')} OR {_HIT("coalesce(path, '')")}), place), md5(text), language, path, context FROM parts WHERE section = 'code'"""
_SCORES = rf"""k AS (SELECT *, CASE WHEN i >= 5 AND i < n - 10 THEN round(least(1e0, CASE WHEN {_ERROR} THEN 0.45e0 ELSE 0e0 END + CASE WHEN {_has('(?s)```.*?```', text='content')} THEN 0.25e0 ELSE 0e0 END + CASE WHEN {_any('content', S.KEY_DECISIONS)} THEN 0.20e0 ELSE 0e0 END
    + least(0.10e0, length(content) / 8000e0) + 0.05e0 * ((i - 5) / greatest(1, n - 16)::DOUBLE)), 9) END AS score FROM m)"""
_ACK = r"(?i)^(?:sure|of course|absolutely|certainly|got it|understood|okay|ok|alright|happy to help|great|sounds good|will do|no problem|perfect)[!.,]?\s*(?:i[''’]?ll|let me|here[''’]?s|i can|to)?\s*[^a-zA-Z]*$"
_CUT = rf"string_split(regexp_replace(regexp_replace({{0}}, '([.!?])\s+', '\1' || chr(2), 'g'), '\n{{{{2,}}}}', chr(2), 'g'), chr(2))"
_TRANSCRIPTS = rf"""{_M}, {_SCORES}, q AS (SELECT session_id, list(score ORDER BY score DESC) AS l FROM k WHERE score IS NOT NULL AND n > 100 GROUP BY session_id), v AS (SELECT k.*, l[greatest(0, floor(len(l) * 0.25e0)::INT - 1) + 1] AS cutoff,
        regexp_extract_all(content, '(?s)```.*?```') AS fs, list_filter(list_transform({_CUT.format("regexp_replace(content, '```.*?```', chr(1), 'gs')")}, lambda x: {_TRIM('x')}), lambda x: x <> '') AS marked, {_TRIM("regexp_replace(content, '```.*?```', '', 'gs')")} AS prose, {_ERROR} AS error FROM k LEFT JOIN q USING (session_id)),
    w AS (SELECT *, array_to_string(marked[:2], ' ') AS head, list_filter(list_transform({_CUT.format('prose')}, lambda x: {_TRIM('x')}), lambda x: length(x) > 10 AND {_any('x', S.KEY_DECISIONS)}) AS said FROM v),
    h AS (SELECT *, string_split(head, chr(1)) AS hs, CASE WHEN length(prose) >= 5 AND NOT {_has(_ACK, text='prose')} AND len(said) > 0 THEN said[1][:200] END AS key FROM w),
    o AS (SELECT *, array_to_string(list_transform(range(0, len(hs)), lambda j: hs[j + 1] || CASE WHEN j < len(hs) - 1 THEN fs[j + 1] ELSE '' END), '') AS inside, array_to_string(fs[len(hs):], chr(10) || chr(10)) AS others FROM h),
    kept AS (SELECT session_id, at_i, role, n, CASE WHEN score IS NULL OR role = 'user' OR n < 30 OR error THEN content WHEN n <= 100 THEN coalesce(nullif({_TRIM("CASE WHEN others <> '' THEN inside || chr(10) || chr(10) || others ELSE inside END")}, ''), content[:200])
        WHEN score >= cutoff AND score >= 0.30e0 THEN content ELSE nullif(concat_ws(chr(10) || chr(10), key, nullif(array_to_string(fs, chr(10) || chr(10)), '')), '') END AS content FROM o)"""
_CATEGORY = lambda c: f"round(coalesce(list_cosine_similarity((SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {CATEGORY_VECTORS[c]}), e.embedding::DOUBLE[]), 0), 6)"


def _chosen(category: str) -> str:
    least, most, floor = S.CATEGORIES[category]
    return f"""{category} AS (SELECT session_id, at_i FROM (SELECT *, {category}_score AS s, count(*) FILTER ({category}_score >= {least}) OVER (PARTITION BY session_id) AS good, row_number() OVER (PARTITION BY session_id ORDER BY {category}_score DESC, at_i) AS b,
        row_number() OVER (PARTITION BY session_id, {category}_score >= {least} ORDER BY round({category}_score * boost, 9) DESC, at_i) AS r FROM sc) WHERE CASE WHEN good < {floor} THEN b <= {floor} ELSE s >= {least} AND r <= {most} END)"""


_BARE = _TRIM("regexp_replace(content, '<context_migration>.*?</context_migration>', '', 'gs')")
_JOINED = lambda c, value: f"(SELECT string_agg({value}, ' | ' ORDER BY at_i) FROM {c} JOIN m USING (session_id, at_i) WHERE {c}.session_id = p.session_id)"
_SCORED = rf"""WITH {_SUMMARY.replace(f"UNION ALL {samples.values(samples.MESSAGES, samples.MESSAGE_COLUMNS)}", "")},
    sc AS (SELECT d.session_id, d.message_index AS at_i, 1 + d.message_index % 1000 / 40e0 AS boost, {', '.join(f'{_CATEGORY(c)} AS {c}_score' for c in CATEGORY_VECTORS)} FROM d JOIN embeddings e ON e.vec_id = d.conv_id * 5 + d.turn),
    {', '.join(_chosen(c) for c in CATEGORY_VECTORS)},
    extra AS (SELECT * FROM told WHERE section = 'decisions' AND (session_id, at_i) IN (SELECT (session_id, at_i) FROM decisions) UNION ALL SELECT * FROM told WHERE section = 'bugs' AND (session_id, at_i) IN (SELECT (session_id, at_i) FROM bugs)),
    both_of AS (SELECT session_id, section, text, 0 AS source, -score AS a, at_i AS b, pos AS c FROM extra UNION ALL SELECT session_id, section, text, 1, 0, place, 0 FROM parts WHERE section IN ('decisions', 'bugs', 'pending', 'completed')),
    uniq AS (SELECT session_id, section, text, {_ORDERED.format('source, a, b, c')} AS place FROM (SELECT * FROM both_of {_ONCE.format('source, a, b, c')})),
    listed AS (SELECT *, ceil(length(text) / 4e0) AS tokens FROM uniq WHERE place <= CASE section WHEN 'decisions' THEN 20 WHEN 'bugs' THEN 15 WHEN 'pending' THEN 10 ELSE 12 END),
    goal AS (SELECT session_id, concat_ws(chr(10), coalesce((SELECT string_agg({_TRIM('said')}, ' | ' ORDER BY at_i) FROM (SELECT at_i, string_split_regex({_BARE}, '[.?!]\s+')[1] AS said, {_BARE} AS bare FROM goals JOIN m USING (session_id, at_i) WHERE goals.session_id = p.session_id) WHERE length(bare) >= 15 AND length(said) BETWEEN 10 AND 600), p.text),
        '[Context: ' || nullif({_JOINED('context', 'content[:300]')}, '') || ']', '[Open: ' || nullif({_JOINED('questions', 'content[:200]')}, '') || ']') AS text FROM parts p WHERE section = 'goal'),
    rest AS (SELECT session_id, sum(ceil(length(text) / 4e0)) AS tokens FROM (SELECT session_id, text FROM parts WHERE section IN ('code', 'tail') UNION ALL SELECT session_id, text FROM goal) GROUP BY session_id),
    trims AS (SELECT *, CASE section WHEN 'decisions' THEN 0 WHEN 'bugs' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END AS k, place > CASE section WHEN 'decisions' THEN 3 WHEN 'bugs' THEN 3 WHEN 'pending' THEN 1 ELSE 2 END AS may FROM listed),
    gone AS (SELECT a.*, (SELECT coalesce(sum(b.tokens), 0) FROM trims b WHERE b.session_id = a.session_id AND b.may AND (b.k < a.k OR b.k = a.k AND b.place > a.place)) AS gone, (SELECT sum(tokens) FROM trims b WHERE b.session_id = a.session_id) + (SELECT tokens FROM rest WHERE rest.session_id = a.session_id) - {BUDGET} AS over_by FROM trims a)
    SELECT session_id, section, place, md5(text) AS text FROM gone WHERE NOT (may AND gone < over_by) UNION ALL SELECT session_id, 'goal', 1, md5(text) FROM goal"""

ORACLES = {
    "session_contexts": _CONTEXTS,
    "session_summaries": _SUMMARIES,
    "task_summaries": _TASKS,
    "scored_messages": f"WITH {_M}, {_SCORES} SELECT session_id, at_i AS message_index, i, score FROM k",
    "session_transcripts": f"WITH {_TRANSCRIPTS} SELECT session_id, at_i AS message_index, role, md5(content) AS md5 FROM kept WHERE content IS NOT NULL",
    "long_transcripts": f"""WITH {_TRANSCRIPTS}, lines AS (SELECT session_id, at_i, n, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS block FROM (SELECT *, string_split(upper(role) || ': ' || content, chr(10) || chr(10)) AS l FROM kept WHERE content IS NOT NULL)),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_i, block) AS p, count(*) OVER (PARTITION BY session_id) AS k FROM lines),
        f AS (SELECT *, p <= 5 OR p > k - 10 AS edge FROM r), t AS (SELECT *, sum(CASE WHEN edge THEN length(text) + 2 ELSE 0 END) OVER (PARTITION BY session_id) + sum(CASE WHEN edge THEN 0 ELSE length(text) + 2 END) OVER (PARTITION BY session_id ORDER BY p DESC) - 2 AS whole FROM f)
        SELECT session_id, at_i AS message_index, block, md5(text) AS md5 FROM t WHERE edge OR n < 30 OR whole <= 48000""",
    "scored_summaries": _SCORED,
}

QUERIES = {name: globals()[name] for name in ORACLES}
