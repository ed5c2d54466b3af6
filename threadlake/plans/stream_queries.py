"""Waiting events and response streams over whole tables, each with its own oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlake.sources import samples
from threadlake.sources.tables import table
from threadlake.streaming import assembly, timers

#: Hours stand for the seconds of the rule: users' events are hours apart.
QUIET, LONGEST = 6 * 3600, 12 * 3600
COOLDOWN, MORE, CALM = 10 * 3600, 3600, 8 * 3600
#: Characters of a piece of a response.
PIECE = 40


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "ts")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at"), F.col("event_id").alias("id"))


def upload_flushes(spark, sf_dir):
    return timers.flushes(_events(spark, sf_dir), QUIET, LONGEST)


def index_admissions(spark, sf_dir):
    return timers.admissions(_events(spark, sf_dir), COOLDOWN, MORE, CALM)


def response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every conversation as lines of a response stream, in one of four forms: snapshots that grow, deltas of
    choices, deltas of content blocks, and socket packets of which the first is not final."""
    rows = table(spark, sf_dir, "conversations").filter("text <> ''").withColumn("name", F.concat(F.lit("t"), F.col("turn").cast("string")))
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(PIECE))).alias("j", "start")).withColumn("piece", F.substring("text", F.col("start") + 1, F.lit(PIECE)))
    upto = F.substring("text", F.lit(1), F.col("start") + PIECE)
    data = lambda *fields: F.concat(F.lit("data: "), F.to_json(F.struct(*fields)))
    named = F.col("name").alias("id")
    snapshot = data(F.struct(named, F.struct("role").alias("author"), F.struct(F.array(upto).alias("parts")).alias("content")).alias("message"))
    choice = data(named, F.array(F.struct(F.struct("role", F.col("piece").alias("content")).alias("delta"))).alias("choices"))
    begin = data(F.lit("message_start").alias("type"), F.struct(named, F.col("role").alias("role")).alias("message"))
    block = data(F.lit("content_block_delta").alias("type"), F.struct(F.col("piece").alias("text")).alias("delta"))
    packet = lambda status, answer: F.concat(F.lit('42["answer",'), F.to_json(F.struct(named, F.lit(status).alias("status"), answer.alias("answer"))), F.lit("]"))
    final = F.col("start") + PIECE >= F.length("text")
    kind = F.pmod("conv_id", F.lit(4))
    lines = (
        F.when(kind == 0, F.array(snapshot)).when(kind == 1, F.array(choice)).when(kind == 2, F.when(F.col("j") == 0, F.array(begin, block)).otherwise(F.array(block)))
        .otherwise(F.when(final, F.array(packet("pending", F.col("piece")), packet("completed", F.col("text")))).otherwise(F.array(packet("pending", F.col("piece")))))
    )
    return rows.select(F.col("conv_id").alias("stream_id"), (F.col("turn") * 1_000_000 + F.col("j") * 2).alias("at"), F.posexplode(lines).alias("k", "line")).select("stream_id", (F.col("at") + F.col("k")).alias("line_number"), "line")


def assembled_streams(spark, sf_dir):
    authored = samples.frame(spark, samples.STREAMS, samples.STREAM_COLUMNS).withColumn("stream_id", -F.col("stream_id"))
    return assembly.assemble(response_lines(spark, sf_dir).unionByName(authored))


_E = "e AS (SELECT user_id AS k, floor(epoch(ts))::BIGINT AS s, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
ORACLES = {
    "upload_flushes": f"""WITH RECURSIVE {_E}, w AS (SELECT k, i, s, id, s AS first_at, 1::BIGINT AS n, least(s + {QUIET}, greatest(s, s + {LONGEST})) AS due FROM e WHERE i = 1
            UNION ALL SELECT e.k, e.i, e.s, e.id, CASE WHEN w.due <= e.s THEN e.s ELSE w.first_at END, CASE WHEN w.due <= e.s THEN 1 ELSE w.n + 1 END,
                CASE WHEN w.due <= e.s THEN e.s + {QUIET} ELSE least(e.s + {QUIET}, greatest(e.s, w.first_at + {LONGEST})) END FROM w JOIN e ON e.k = w.k AND e.i = w.i + 1)
        SELECT k AS "key", due AS fired_at, first_at, n, id AS last_id FROM w QUALIFY lead(first_at) OVER (PARTITION BY k ORDER BY i) IS NULL OR lead(n) OVER (PARTITION BY k ORDER BY i) = 1""",
    # The state before each event: the last admission, the check that waits (-1: none), the last capture, times put off, captures
    # that wait. Between two captures a check is put off once at most, as the next one finds quiet.
    "index_admissions": f"""WITH RECURSIVE {_E}, w AS (SELECT k, 0::BIGINT AS i, -1::BIGINT AS adm, -1::BIGINT AS chk, 0::BIGINT AS last, 0::BIGINT AS off, 0::BIGINT AS n, NULL::BIGINT AS out_at, NULL::VARCHAR AS out_why, NULL::BIGINT AS out_n, NULL::BIGINT AS now_at, NULL::BIGINT AS now_n FROM e WHERE i = 1
            UNION ALL SELECT k, i, CASE WHEN once THEN s ELSE adm2 END, CASE WHEN once THEN -1 WHEN chk2 >= 0 THEN chk2 ELSE s + {COOLDOWN + MORE} END, s, CASE WHEN once OR chk2 < 0 THEN 0 ELSE off2 END, CASE WHEN once THEN 0 ELSE n2 + 1 END, out_at, out_why, out_n, CASE WHEN once THEN s END, CASE WHEN once THEN n2 + 1 END FROM (
                SELECT *, chk2 < 0 AND (adm2 < 0 OR s - adm2 >= {COOLDOWN}) AS once FROM (
                    SELECT *, CASE WHEN out_at IS NULL THEN adm ELSE out_at END AS adm2, CASE WHEN out_at IS NOT NULL THEN -1 WHEN later THEN chk + {COOLDOWN + MORE} ELSE chk END AS chk2, CASE WHEN out_at IS NOT NULL THEN 0 WHEN later THEN off + 1 ELSE off END AS off2, CASE WHEN out_at IS NOT NULL THEN 0 ELSE n END AS n2 FROM (
                        SELECT *, CASE WHEN chk < 0 OR chk > s THEN NULL WHEN NOT later THEN chk WHEN chk + {COOLDOWN + MORE} <= s THEN chk + {COOLDOWN + MORE} END AS out_at, CASE WHEN chk < 0 OR chk > s THEN NULL WHEN later THEN 'deferred' WHEN chk - last < {CALM} THEN 'forced' ELSE 'deferred' END AS out_why, n AS out_n FROM (
                            SELECT e.k, e.i, e.s, w.adm, w.chk, w.last, w.off, w.n, w.chk >= 0 AND w.chk <= e.s AND w.chk - w.last < {CALM} AND w.off < 5 AND w.n < 50 AS later FROM w JOIN e ON e.k = w.k AND e.i = w.i + 1))))),
        z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)
        SELECT k AS "key", out_at AS "at", out_why AS why, out_n AS n FROM w WHERE out_at IS NOT NULL UNION ALL SELECT k, now_at, 'at once', now_n FROM w WHERE now_at IS NOT NULL
        UNION ALL SELECT k, CASE WHEN chk - last < {CALM} AND off < 5 AND n < 50 THEN chk + {COOLDOWN + MORE} ELSE chk END, CASE WHEN chk - last < {CALM} AND (off >= 5 OR n >= 50) THEN 'forced' ELSE 'deferred' END, n FROM z WHERE chk >= 0""",
    "assembled_streams": """SELECT conv_id AS stream_id, 't' || turn AS message_id, CASE WHEN conv_id % 4 = 3 THEN 'assistant' ELSE role END AS role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM conversations WHERE regexp_matches(text, '\\S') AND (conv_id % 4 <> 0 OR role IN ('user', 'assistant'))
        UNION ALL SELECT * FROM (VALUES (-1, 'm1', 'assistant', 'Hello there friend'), (-2, 'c9', 'assistant', 'One two'), (-3, 'u', 'user', 'typed text'), (-4, 'k', 'assistant', 'a much longer replacement'), (-6, 'b1', 'assistant', 'Block text'), (-7, 'p1', 'assistant', 'The whole answer')) v""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
