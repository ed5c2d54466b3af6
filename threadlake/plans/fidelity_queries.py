"""What transcripts and tails of the dialogues keep of them, signals of messages and what records call for; the SQL is
written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlake.operators import fidelity as O, summaries as S
from threadlake.plans import detail_queries
from threadlake.plans.operator_oracles import _has
from threadlake.plans.summary_queries import _M, _TRANSCRIPTS, _TRIM, _all

GOAL = "Build the endpoint and keep the schema"


def _outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each session's transcript, the half of its messages cut to 120 characters without roles, and for a fifth nothing."""
    m = _all(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("content"))
    joined = lambda rows, line, tier: rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", line.alias("l")))), lambda x: x["l"]), "\n").alias("output")).withColumn("tier", F.lit(tier))
    whole = joined(S.transcripts(m).select("session_id", "message_index", "role", "content"), said, "transcript")
    half = joined(m.filter("message_index % 2 = 0"), F.substring("content", 1, 120), "half")
    none = m.filter("session_id % 5 = 0").select("session_id", F.lit("  \n").alias("output"), F.lit("none").alias("tier")).distinct()
    return m, whole.unionByName(half).unionByName(none)


def output_fidelity(spark, sf_dir):
    return O.fidelity(*_outputs(spark, sf_dir))


def lost_items(spark, sf_dir):
    return O.lost_items(*_outputs(spark, sf_dir)).withColumn("text", F.md5("text"))


def signal_scores(spark, sf_dir):
    return O.signal_scores(_all(spark, sf_dir), GOAL)


def chunk_buckets(spark, sf_dir):
    """Messages and their blocks of code as chunks, with the score of their message; sessions divisible by 7 without decisions."""
    m = _all(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    blocks = m.select("session_id", "message_index", F.posexplode(F.regexp_extract_all("content", F.lit(O.FENCE), 1)).alias("pos", "text"))
    chunks = m.select("session_id", "message_index", F.lit("message").alias("kind"), "content", F.lit(0).alias("pos")).withColumnRenamed("content", "text")
    chunks = chunks.unionByName(blocks.withColumn("pos", F.col("pos") + 1).withColumn("kind", F.lit("code"))).filter("session_id % 7 <> 0 OR kind = 'code' OR message_index % 3 = 0")
    scored = chunks.join(O.signal_scores(m, GOAL), ["session_id", "message_index"])
    text = F.when((F.col("session_id") % 7 == 0) & (F.col("kind") == "message"), F.lit("words")).otherwise(F.col("text"))
    return O.bucketed(scored.select("session_id", (F.col("message_index") * 100 + F.col("pos")).alias("chunk_id"), "kind", text.alias("text"), "score"))


def content_roles(spark, sf_dir):
    return O.content_roles(_all(spark, sf_dir))


def recommendations(spark, sf_dir):
    r = detail_queries.scored_outputs(spark, sf_dir)
    return O.recommendations(r.select(F.concat(F.lit("p"), (F.col("session_id") % 6).cast("string")).alias("platform"), "score", "code", "retention", "compression"))


_SIDE = lambda role: f"CASE WHEN {role} = 'user' THEN 'User: ' ELSE 'Assistant: ' END"
_WORDS = lambda x: f"list_filter(string_split_regex(lower({x}), '\\W+'), lambda w: length(w) > 4)"
_ALIKE = f"(len({_WORDS('text')}) = 0 OR len(list_filter({_WORDS('text')}, lambda w: contains(lower(output), w))) / len({_WORDS('text')}) >= 0.6e0)"
_BLOCKS = lambda x: f"list_transform(regexp_extract_all({x}, '(?s)```.*?```'), lambda b: {_TRIM('b')})"
_HALF = lambda found, of: f"floor({found} / {of} * 100 + 0.5e0)::BIGINT"
_FACTS = "must|cannot|requires|version|api key|endpoint|port"
_CHOICES = "instead of|chose|decided|trade.off|going with|opted for|let.s use|sticking with|switching to"
_BASE = rf"""WITH {_TRANSCRIPTS},
    outs AS (SELECT session_id, 'transcript' AS tier, string_agg({_SIDE('role')} || content, chr(10) ORDER BY at_i) AS output FROM kept WHERE content IS NOT NULL GROUP BY session_id
        UNION ALL SELECT session_id, 'half', string_agg(content[:120], chr(10) ORDER BY at_i) FROM m WHERE at_i % 2 = 0 GROUP BY session_id
        UNION ALL SELECT DISTINCT session_id, 'none', '' FROM m WHERE session_id % 5 = 0),
    cl AS (SELECT session_id, at_i, unnest(l) AS u, generate_subscripts(l, 1) AS pos FROM (SELECT *, list_transform(string_split_regex(content, '[.!?\n]'), lambda s: {_TRIM('s')}) AS l FROM m)),
    it AS (SELECT session_id, 'fact' AS section, u AS text, row_number() OVER (PARTITION BY session_id ORDER BY at_i, pos) AS place, 8 AS cap FROM cl WHERE length(u) > 15 AND {_has(_FACTS, 'i', 'u')}
        UNION ALL SELECT session_id, 'decision', u, row_number() OVER (PARTITION BY session_id ORDER BY at_i, pos), 8 FROM cl WHERE length(u) > 15 AND {_has(_CHOICES, 'i', 'u')}
        UNION ALL SELECT session_id, 'completed', {_TRIM("split_part(content, chr(10), 1)")}, row_number() OVER (PARTITION BY session_id ORDER BY at_i), 12 FROM m WHERE role = 'assistant' AND {_has('here.s|done|created|fixed|implemented|finished', 'i', 'content')} AND length({_TRIM("split_part(content, chr(10), 1)")}) > 10
        UNION ALL SELECT c.session_id, 'pending', u, row_number() OVER (PARTITION BY c.session_id ORDER BY c.at_i), 10 FROM cl c JOIN m USING (session_id, at_i) WHERE pos = 1 AND {_has('todo|next step|remaining|still need|will need', 'i', 'content')} AND length(u) > 10
        UNION ALL SELECT session_id, 'goal', arg_min(content, at_i)[:600], 1, 1 FROM m WHERE role = 'user' GROUP BY session_id HAVING arg_min(content, at_i) <> ''),
    met AS (SELECT session_id, tier, section, place, text, {_ALIKE} AS held FROM it JOIN outs USING (session_id) WHERE place <= cap),
    bl AS (SELECT session_id, at_i, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT session_id, at_i, {_BLOCKS('content')} AS l FROM m)),
    cd AS (SELECT session_id, tier, b, at_i, pos, list_contains({_BLOCKS('output')}, b) AS held FROM bl JOIN outs USING (session_id))"""
_FIDELITY = rf"""{_BASE},
    ln AS (SELECT session_id, tier, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT session_id, tier, list_filter(string_split(output, chr(10)), lambda s: starts_with(s, 'User:') OR starts_with(s, 'Assistant:')) AS l FROM outs)),
    ro AS (SELECT ln.session_id, tier, count(*) FILTER (m.i IS NOT NULL AND starts_with(line, 'User:') = coalesce(role = 'user', false)) AS ok, count(*) AS k FROM ln LEFT JOIN m ON m.session_id = ln.session_id AND m.i = ln.i GROUP BY ALL),
    sem AS (SELECT session_id, tier, count(*) FILTER (section IN ('goal', 'fact', 'decision')) AS s_n, count(*) FILTER (section IN ('goal', 'fact', 'decision') AND held) AS s_k, count(*) FILTER (section IN ('completed', 'pending')) AS t_n, count(*) FILTER (section IN ('completed', 'pending') AND held) AS t_k FROM met GROUP BY ALL),
    co AS (SELECT session_id, tier, count(*) AS had, count(*) FILTER (held) AS k_c FROM cd GROUP BY ALL),
    si AS (SELECT session_id, count(*) AS n_m, sum(length(content)) AS chars FROM m GROUP BY session_id),
    p AS (SELECT session_id, tier, output = '' AS blank, CASE WHEN ro.k IS NULL THEN 50 ELSE {_HALF('ok', 'n_m')} END AS roles, CASE WHEN had IS NULL THEN 100 ELSE {_HALF('k_c', 'had')} END AS code,
        CASE WHEN coalesce(s_n, 0) = 0 THEN 100 ELSE {_HALF('s_k', 's_n')} END AS semantic, CASE WHEN coalesce(t_n, 0) = 0 THEN 100 ELSE {_HALF('t_k', 't_n')} END AS tasks,
        CASE WHEN chars = 0 THEN 100 WHEN length(output) / chars >= 0.4e0 THEN 100 WHEN length(output) / chars >= 0.2e0 THEN 75 WHEN length(output) / chars >= 0.1e0 THEN 50 ELSE 25 END AS compression
        FROM outs JOIN si USING (session_id) LEFT JOIN ro USING (session_id, tier) LEFT JOIN sem USING (session_id, tier) LEFT JOIN co USING (session_id, tier)),
    zq AS (SELECT session_id, tier, {", ".join(f"CASE WHEN blank THEN 0 ELSE {c} END AS {c}" for c in O.WEIGHTS)} FROM p),
    t AS (SELECT *, floor(roles * 0.20e0 + code * 0.25e0 + semantic * 0.25e0 + tasks * 0.15e0 + compression * 0.15e0 + 0.5e0)::BIGINT AS total FROM zq)
    SELECT *, CASE WHEN total >= 90 THEN 'Excellent' WHEN total >= 70 THEN 'Good' WHEN total >= 50 THEN 'Degraded' ELSE 'Fail' END AS grade FROM t"""
_LOST = f"""{_BASE} SELECT session_id, tier, section, place, md5(text[:60]) AS text FROM met WHERE NOT held AND tier <> 'none'
    UNION ALL SELECT session_id, tier, 'code', min(at_i * 1000 + pos), md5(b[:40]) FROM cd WHERE NOT held AND tier <> 'none' GROUP BY session_id, tier, b"""
_ERRORS = f"({_has(chr(92) + 'b(?:Traceback|TypeError|ValueError|ReferenceError|SyntaxError|RuntimeError)' + chr(92) + 'b', 'c', 'content')} OR " + " OR ".join([
    _has(r"\bat\s+\w[\w.]*\s+\([^)]+:\d+:\d+\)|\bError:\s+\S|\bException\s+in\s+thread\b", "c", "content"),
    _has(r"\b(?:the issue was|root cause|bug was caused|fixed by|caused by|turned out (?:to be|that)|regression|race condition|deadlock|memory leak)\b", "i", "content"),
]) + ")"
_CHOSEN = _has(r"\b(?:we decided|decided to|going with|opted for|we(?:''?ll| will) use|chose to|switching to|migrating to|best approach|the approach is|we use|went with|should use|must use|the solution|architecture|the plan)\b", "i", "content")
_AIMS = _has(r"\b(?:the goal|our goal|we want to|we need to|we(?:''?re| are) building|next step|the plan)\b", "i", "content")
_GOAL_WORDS = "['build', 'endpoint', 'keep', 'schema']"
_SIGNALLED = f"""sc AS (SELECT session_id, at_i, i, n, round(least(1e0, least(0.92e0, CASE WHEN {_ERRORS} THEN 0.30e0 ELSE 0e0 END + CASE WHEN {_CHOSEN} THEN 0.25e0 ELSE 0e0 END + CASE WHEN {_AIMS} THEN 0.15e0 ELSE 0e0 END + CASE WHEN {_has('(?s)```.*?```', 'c', 'content')} THEN 0.15e0 ELSE 0e0 END
    + least(0.07e0, length(content) / 8000e0)) + 0.08e0 * (len(list_filter({_GOAL_WORDS}, lambda w: contains(lower(content), w))) / 4e0) + 0.08e0 * (i / greatest(1, n - 1))), 9) AS score FROM m)"""
_LEADING = r"\b(?:decided|decision|conclusion|agreed|agree|resolution|chose|choose|switched|switch|fixed|resolved|approach|selected|determined|confirmed|plan|strategy|architecture|refactor|migrate|adopted|pivoted|went with|settled on|root cause|bug|issue|error|problem)\b"
_BUCKETS = f"""WITH {_M}, {_SIGNALLED}, xb AS (SELECT session_id, at_i, unnest(l) AS text, generate_subscripts(l, 1) AS pos FROM (SELECT session_id, at_i, regexp_extract_all(content, '(?s)```.*?```') AS l FROM m)),
    ch AS (SELECT session_id, at_i * 100 AS chunk_id, at_i, 'message' AS kind, CASE WHEN session_id % 7 = 0 THEN 'words' ELSE content END AS text FROM m WHERE session_id % 7 <> 0 OR at_i % 3 = 0 UNION ALL SELECT session_id, at_i * 100 + pos, at_i, 'code', text FROM xb),
    da AS (SELECT session_id, chunk_id, score, kind, kind = 'message' AND {_has(_LEADING, 'i', 'text')} AS lead FROM ch JOIN sc USING (session_id, at_i)),
    db AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind, lead ORDER BY score DESC, chunk_id) AS r FROM da), dc AS (SELECT *, CASE WHEN lead AND r <= 8 THEN 'decisions' WHEN kind = 'code' AND r <= 8 THEN 'code' ELSE 'context' END AS section FROM db),
    dd AS (SELECT session_id, section, chunk_id, row_number() OVER (PARTITION BY session_id, section ORDER BY score DESC, chunk_id) AS place FROM dc QUALIFY place <= 8),
    de AS (SELECT *, count(*) FILTER (section = 'decisions') OVER (PARTITION BY session_id) = 0 AND count(*) FILTER (section = 'context') OVER (PARTITION BY session_id) > 2 AND section = 'context' AS lends FROM dd)
    SELECT session_id, chunk_id, CASE WHEN lends AND place <= 3 THEN 'decisions' ELSE section END AS section, CASE WHEN lends AND place > 3 THEN place - 3 ELSE place END AS place FROM de"""

ORACLES = {
    "output_fidelity": _FIDELITY,
    "lost_items": _LOST,
    "signal_scores": f"WITH {_M}, {_SIGNALLED} SELECT session_id, at_i AS message_index, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, i) <= greatest(5, n // 4) AS top FROM sc",
    "chunk_buckets": _BUCKETS,
    "content_roles": rf"""WITH {_M} SELECT session_id, at_i AS message_index, CASE WHEN contains(t, '```') OR regexp_matches(t, '^#{{1,3}}\s|\*\*[^*]|\n- ') OR length(t) > 200 THEN 'assistant' ELSE 'user' END AS inferred FROM (SELECT *, {_TRIM('content')} AS t FROM m) WHERE length(t) >= 10""",
    "recommendations": f"""WITH rr AS ({detail_queries.ORACLES['scored_outputs']}), p AS (SELECT *, 'p' || session_id % 6 AS platform FROM rr)
        SELECT 'retention' AS kind, NULL::VARCHAR AS platform, round(avg(retention), 6) AS value FROM p HAVING avg(retention) < 12 UNION ALL SELECT 'code', NULL, count(*)::DOUBLE FROM p WHERE code < 18 HAVING count(*) >= 3
        UNION ALL SELECT 'compression', NULL, round(avg(compression), 6) FROM p HAVING avg(compression) < 7 UNION ALL SELECT 'platform', platform, round(avg(score), 6) FROM p GROUP BY platform HAVING count(*) >= 2 AND avg(score) < 75""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
