"""Queries over the session operators, each with an oracle written from its rule."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from threadlake.operators import sessions as S
from threadlake.plans.operator_oracles import CHUNKS, MESSAGES
from threadlake.plans.operator_queries import chunks, messages, orders
from threadlake.sources.tables import table


def validated_messages(spark, sf_dir):
    return S.valid_messages(messages(spark, sf_dir)).select("session_id", "message_index", "role")


def validated_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.when(F.col("doc_id") % 5 == 0, F.lit("bad platform!")).otherwise(F.col("source")).alias("platform"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("title"))
    return S.valid_sessions(rows)


def validated_chunks(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("embedding", F.when(F.col("chunk_id") % 4 == 0, F.array().cast("array<float>")).when(F.col("chunk_id") % 4 == 1, F.transform("embedding", lambda x: F.when(x > 0, x))).otherwise(F.col("embedding")))
    return S.valid_chunks(rows).select("chunk_id", F.size("embedding").cast("bigint").alias("n"))


def tail_chunks(spark, sf_dir):
    m = messages(spark, sf_dir)
    late = S.newest(m, 6, "session_id", "message_index", "role")
    held = m.filter("message_index % 2 = 0").select("role", "content", (F.col("session_id") * 100 + F.col("message_index")).alias("chunk_id"))
    return S.chunks_of_messages(late, held, "role", "content").select("session_id", "message_index", "chunk_id")


def hit_sessions(spark, sf_dir):
    hits = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("session_id"), (F.col("vec_id") * 37 % 101).alias("score"))
    sessions = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("n"))
    return hits.join(sessions, "session_id").orderBy(F.desc("score"), "session_id").limit(20)


def tombstoned_sessions(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("conv_id"))
    return table(spark, sf_dir, "conversations").join(gone, "conv_id", "left_semi").select(F.col("conv_id").alias("session_id")).distinct()


def touched_suppliers(spark, sf_dir):
    """Suppliers stand for modules, their parts for files; those of one brand are the highlighted files."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    modules = l.groupBy(F.col("l_suppkey").alias("name")).agg(F.collect_set("l_partkey").alias("files"))
    files = table(spark, sf_dir, "part").filter("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("file"))
    return S.touched(modules, files)


def resolved_templates(spark, sf_dir):
    sessions = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.concat(F.lit("p"), (F.col("conv_id") % 6).cast("string")).alias("platform")).distinct()
    o = orders(spark, sf_dir).filter("o_orderstatus = 'P'")
    assigned = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("template_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("session_id"), F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("p"), (F.col("o_custkey") % 4).cast("string"))).alias("platform"))
    return S.resolved_templates(sessions, assigned, "default")


def row_warnings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = {"survival": F.col("doc_id") % 26, "integrity": F.col("n_chars") % 21, "freshness": F.col("n_chars") % 16, "retention": F.col("doc_id") % 16}
    return d.select("doc_id", F.array_join(S.warnings(parts), "; ").alias("warnings"))


def index_stats(spark, sf_dir):
    c = chunks(spark, sf_dir)
    complete = table(spark, sf_dir, "conversations").filter("conv_id % 2 = 0").select(F.col("conv_id").alias("session_id")).distinct()
    n_both = complete.join(c, "session_id", "left_semi").agg(F.count("*").alias("complete_sessions"))
    stats = c.agg(F.count("*").alias("chunks"), F.count_distinct("session_id").alias("sessions"), F.floor(F.count("*") * 384 * 4 / 1048576 + 0.5).cast("bigint").alias("storage_mb"))
    return stats.crossJoin(n_both)  # one row each


def template_stats(spark, sf_dir):
    o = orders(spark, sf_dir)
    usage = o.groupBy(F.col("o_custkey").alias("template_id")).agg(F.count("*").alias("usage"))
    totals = usage.agg(F.count("*").alias("templates"), F.sum("usage").alias("total_usage"), F.max_by("template_id", F.struct("usage", -F.col("template_id"))).alias("most_used"))
    platform = o.groupBy("o_orderpriority").agg(F.count("*").alias("n")).agg(F.max_by("o_orderpriority", F.struct("n", "o_orderpriority")).alias("top_platform"))
    return totals.crossJoin(platform)  # one row each


def run_regressions(spark, sf_dir):
    """Users' months as runs: the mean value is the score."""
    runs = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(F.round(F.avg("value"), 6).alias("score"))
    before = F.lag("score").over(Window.partitionBy("user_id").orderBy("run"))
    runs = runs.withColumn("regressed", F.coalesce(F.col("score") < before, F.lit(False)))
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if("regressed").alias("regressions"), F.count_if(F.col("score") >= 70).alias("passed"), F.min_by("run", F.struct("score", "run")).alias("lowest"))


def capped_blocks(spark, sf_dir):
    blocks = messages(spark, sf_dir).select("session_id", F.col("message_index").alias("place"), F.coalesce(F.length("content"), F.lit(0)).alias("size"))
    return S.budgeted_blocks(blocks, 1500, 1, 2).select("session_id", "place")


def newest_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), "ts")
    return S.newest(rows, 20, "session_id", "ts", "id").select("session_id", "id")


def evicted_chunks(spark, sf_dir):
    return S.evicted(chunks(spark, sf_dir), 100, "message_index", "chunk_id").select("chunk_id")


def stale_chunks(spark, sf_dir):
    fresh = table(spark, sf_dir, "documents").filter("n_chars > 500").select(F.col("doc_id").alias("chunk_id"))
    return chunks(spark, sf_dir).join(fresh, "chunk_id", "left_anti").select("chunk_id", "session_id")


def newest_by_key(spark, sf_dir):
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return S.newest(rows, 1, "key", "o_orderdate", "id").select("key", "id")


def merged_attributes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    sets = l.groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return sets.select("l_suppkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("attributes"))


def session_union(spark, sf_dir):
    """Two sessions of each pair (n, n + 1), n even, as sections of one."""
    m = messages(spark, sf_dir)
    union = m.filter("session_id % 2 = 0").select(F.col("session_id").alias("first_id"), F.lit(1).alias("section"), "message_index").unionByName(m.filter("session_id % 2 = 1").select((F.col("session_id") - 1).alias("first_id"), F.lit(2).alias("section"), "message_index"))
    return union.select("first_id", F.row_number().over(Window.partitionBy("first_id").orderBy("section", "message_index")).cast("bigint").alias("place"), "section", "message_index")


def top_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.round(F.col("n_chars") / 100, 2).alias("score"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))).filter("r <= 5").select("source", "doc_id", "score")


def templates_by_usage(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("template_id")).agg(F.count("*").alias("usage"))
    return used.withColumn("owner", F.when(F.col("template_id") % 4 == 0, "system").otherwise("user")).orderBy("owner", F.desc("usage"), "template_id").limit(50)


def capped_openers(spark, sf_dir):
    """The first eight different openings of each session's messages, in order."""
    m = messages(spark, sf_dir).filter("content <> ''").withColumn("opening", F.lower(F.substring("content", 1, 12)))
    first = m.groupBy("session_id", "opening").agg(F.min("message_index").alias("at"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("at", "opening"))).filter("r <= 8").select("session_id", "opening", "at")


def meaningful_sentences(spark, sf_dir):
    return messages(spark, sf_dir).select("session_id", "message_index", S.sentence(F.coalesce("content", F.lit(""))).alias("sentence"))


def usage_months(spark, sf_dir):
    day = F.to_date("ts")
    reset = F.add_months(F.trunc(day, "month"), 1)
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM").alias("month"), F.date_format(reset, "yyyy-MM-dd").alias("reset"), F.datediff(reset, day).cast("bigint").alias("days"))


def formatted(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("at"), S.byte_size(F.col("event_id") * F.col("event_id") * 7).alias("size"))


def parsed_properties(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props")))
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("k"))


def technologies_used(spark, sf_dir):
    return messages(spark, sf_dir).select("session_id", F.explode(S.technologies(F.coalesce("content", F.lit("")))).alias("technology")).distinct()


def module_types(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    functions = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    classes = F.when(F.col("page_id") % 5 == 0, F.array(F.lit("MainProps"))).otherwise(F.array().cast("array<string>"))
    return p.select("page_id", S.module_type(F.col("url"), functions, classes).alias("module_type"))


def inferred_roles(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("session_id", "message_index", F.when(F.pmod("message_index", F.lit(2)) == 0, "user").otherwise("assistant").alias("inferred"), (F.when(F.pmod("message_index", F.lit(2)) == 0, "user").otherwise("assistant") == F.col("role")).alias("agrees"))


def token_warnings(spark, sf_dir):
    names = ["claude", "chatgpt", "gemini", "grok", "perplexity", "deepseek", "other"]
    d = table(spark, sf_dir, "documents").groupBy(F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 7 + 1).cast("int")).alias("platform"), "lang").agg(F.sum("n_chars").alias("chars"))
    return S.token_warnings(d)


def fuzzy_matches(spark, sf_dir):
    m = messages(spark, sf_dir).filter("content <> ''")
    following = F.lead("content").over(Window.partitionBy("session_id").orderBy("message_index"))
    return m.withColumn("after", following).filter("after IS NOT NULL").select("session_id", "message_index", S.like_enough(S.long_words(F.substring("content", 1, 80)), F.lower("after")).alias("kept"))


def last_chunks(spark, sf_dir):
    return S.newest(chunks(spark, sf_dir), 15, "session_id", "message_index", "chunk_id").select("session_id", "chunk_id")


def focused_context(spark, sf_dir):
    """Up to ten prose chunks, in order, and the five best code chunks of each session, over 0.5."""
    c = chunks(spark, sf_dir).withColumn("score", (F.col("chunk_id") * 37 % 101) / 100).filter("score >= 0.5 AND text IS NOT NULL")
    order = F.when(F.col("has_code"), -F.col("score")).otherwise(F.col("message_index"))
    w = Window.partitionBy("session_id", "has_code").orderBy(order, "chunk_id")
    kept = c.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.when(F.col("has_code"), 5).otherwise(10))
    return kept.select("session_id", "has_code", F.col("r").cast("bigint").alias("place"), F.md5(F.substring("text", F.lit(1), F.when(F.col("has_code"), 2000).otherwise(1500))).alias("md5"))


def exported_markdown(spark, sf_dir):
    return S.markdown(messages(spark, sf_dir))


def exported_csv(spark, sf_dir):
    return S.csv(messages(spark, sf_dir))


def sliding_limits(spark, sf_dir):
    """Requests of the last 60 minutes, the current one included, against a limit of three."""
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "ts")
    e = table(spark, sf_dir, "events").withColumn("at", at)
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-3600, 0))
    return e.select("event_id", n.alias("n"), (n <= 3).alias("ok"))


_TAILS = "row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC, role DESC)"
ORACLES = {
    "validated_messages": f"WITH {MESSAGES} SELECT session_id, message_index, role FROM messages WHERE role IN ('user', 'assistant') AND content IS NOT NULL",
    "validated_sessions": "SELECT doc_id AS session_id, source AS platform, CASE WHEN doc_id % 3 > 0 AND text IS NOT NULL THEN text[:500] ELSE doc_id::VARCHAR END AS title FROM documents WHERE doc_id % 5 <> 0 AND regexp_full_match(source, '[A-Za-z0-9_-]{2,32}')",
    "validated_chunks": f"""WITH {CHUNKS}, c AS (SELECT chunk_id, CASE chunk_id % 4 WHEN 0 THEN 0 WHEN 1 THEN length(list_filter(embedding, lambda x: x > 0)) ELSE length(embedding) END AS n FROM chunks WHERE text IS NOT NULL) SELECT chunk_id, n FROM c WHERE n > 0""",
    "tail_chunks": f"""WITH {MESSAGES}, late AS (SELECT * FROM messages QUALIFY {_TAILS} <= 6)
        SELECT session_id, message_index, (SELECT min(h.session_id * 100 + h.message_index) FROM messages h WHERE h.message_index % 2 = 0 AND h.role = late.role AND h.content = late.content) AS chunk_id FROM late""",
    "hit_sessions": "SELECT vec_id AS session_id, vec_id * 37 % 101 AS score, (SELECT count(*) FROM conversations WHERE conv_id = vec_id) AS n FROM embeddings WHERE vec_id IN (SELECT conv_id FROM conversations) ORDER BY score DESC, vec_id LIMIT 20",
    "tombstoned_sessions": "SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "touched_suppliers": "SELECT DISTINCT l_suppkey AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#11'",
    "resolved_templates": """WITH s AS (SELECT DISTINCT conv_id AS session_id, 'p' || conv_id % 6 AS platform FROM conversations), a AS (SELECT * FROM orders WHERE o_orderstatus = 'P')
        SELECT session_id, platform, coalesce('t' || (SELECT min(o_orderkey) FROM a WHERE o_orderkey % 2 = 0 AND o_custkey = session_id), 't' || (SELECT min(o_orderkey) FROM a WHERE o_orderkey % 2 = 1 AND 'p' || o_custkey % 4 = platform), 'default') AS template_id FROM s""",
    "row_warnings": """SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 26 < 15 THEN 'Low message survival — check compression' END, CASE WHEN n_chars % 21 < 12 THEN 'Code blocks lost or truncated' END,
        CASE WHEN n_chars % 16 < 10 THEN 'Recent messages not preserved' END, CASE WHEN doc_id % 16 < 8 THEN 'Key decisions / signals dropped' END) AS warnings FROM documents""",
    "index_stats": "SELECT count(*) AS chunks, count(DISTINCT label) AS sessions, round(count(*) * 1536 / 1048576e0)::BIGINT AS storage_mb, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 2 = 0 AND conv_id IN (SELECT label FROM embeddings)) AS complete_sessions FROM embeddings",
    "template_stats": """WITH u AS (SELECT o_custkey AS t, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL)
        SELECT count(*) AS templates, sum(n)::BIGINT AS total_usage, (SELECT t FROM u ORDER BY n DESC, t LIMIT 1) AS most_used, (SELECT p FROM p ORDER BY n DESC, p DESC LIMIT 1) AS top_platform FROM u""",
    "run_regressions": """WITH r AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS run, round(avg(value), 6) AS score FROM events GROUP BY ALL), b AS (SELECT *, lag(score) OVER (PARTITION BY user_id ORDER BY run) AS was FROM r)
        SELECT user_id, count(*) AS runs, count(*) FILTER (score < was) AS regressions, count(*) FILTER (score >= 70) AS passed, first(run ORDER BY score, run) AS lowest FROM b GROUP BY user_id""",
    "capped_blocks": f"""WITH {MESSAGES}, b AS (SELECT session_id, message_index AS place, coalesce(length(content), 0) AS size, count(*) OVER (PARTITION BY session_id) AS n FROM messages),
        m AS (SELECT *, place < 1 OR place >= n - 2 AS edge FROM b)
        SELECT session_id, place FROM m WHERE edge OR (SELECT sum(o.size) + 2 * count(*) - 2 FROM m o WHERE o.session_id = m.session_id AND (o.edge OR o.place >= m.place)) <= 1500""",
    "newest_summaries": "SELECT user_id AS session_id, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20",
    "evicted_chunks": "SELECT vec_id AS chunk_id FROM embeddings WHERE (SELECT count(*) FROM embeddings) > 100 QUALIFY row_number() OVER (ORDER BY vec_id // 10, vec_id) <= floor((SELECT count(*) FROM embeddings) * 0.2)",
    "stale_chunks": "SELECT vec_id AS chunk_id, label::BIGINT AS session_id FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = vec_id AND n_chars > 500)",
    "newest_by_key": "SELECT o_custkey AS key, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS id FROM orders GROUP BY o_custkey",
    "merged_attributes": "WITH a AS (SELECT l_suppkey, l_returnflag AS x FROM lineitem UNION SELECT l_suppkey, l_linestatus FROM lineitem) SELECT l_suppkey, string_agg(x, ',' ORDER BY x) AS attributes FROM a GROUP BY l_suppkey",
    "session_union": f"WITH {MESSAGES} SELECT session_id - session_id % 2 AS first_id, row_number() OVER (PARTITION BY session_id - session_id % 2 ORDER BY session_id, message_index) AS place, (session_id % 2 + 1)::INT AS section, message_index FROM messages",
    "top_sections": "SELECT source, doc_id, round(n_chars / 100e0, 2) AS score FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(n_chars / 100e0, 2) DESC, doc_id) <= 5",
    "templates_by_usage": "SELECT l_suppkey AS template_id, count(*) AS usage, CASE WHEN l_suppkey % 4 = 0 THEN 'system' ELSE 'user' END AS owner FROM lineitem GROUP BY l_suppkey ORDER BY owner, usage DESC, template_id LIMIT 50",
    "capped_openers": f"""WITH {MESSAGES}, o AS (SELECT session_id, lower(content[:12]) AS opening, min(message_index) AS first_at FROM messages WHERE content <> '' GROUP BY ALL) SELECT session_id, opening, first_at AS "at" FROM o QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY first_at, opening) <= 8""",
    "meaningful_sentences": rf"""WITH {MESSAGES}, p AS (SELECT session_id, message_index, trim(regexp_replace(regexp_replace(coalesce(content, ''), '```.*?```', ' ', 'gs'), '\s+', ' ', 'g')) AS plain FROM messages),
        s AS (SELECT *, trim(coalesce(nullif(regexp_extract(plain, '[^.?!]{{8,300}}[.?!]'), ''), plain)) AS c FROM p) SELECT session_id, message_index, CASE WHEN length(c) > 280 THEN c[:277] || '…' ELSE c END AS sentence FROM s""",
    "usage_months": "SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m-%d') AS reset, date_diff('day', ts::DATE, (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE) AS days FROM events",
    "formatted": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS at, CASE WHEN event_id * event_id * 7 < 1024 THEN (event_id * event_id * 7) || 'B' WHEN event_id * event_id * 7 < 1048576 THEN format('{:.1f}KB', event_id * event_id * 7 / 1024e0) ELSE format('{:.1f}MB', event_id * event_id * 7 / 1048576e0) END AS size FROM events""",
    "parsed_properties": "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE coalesce((props->>'$.k')::BIGINT, 0) END AS k FROM events",
    "technologies_used": rf"""WITH {MESSAGES}, t(p, technology) AS (VALUES ('\breact\b', 'React'), ('\bnext[/\s]|next\.config', 'Next.js'), ('\bvite\b', 'Vite'), ('\bvue\b', 'Vue'), ('\bsvelte\b', 'Svelte'), ('\bangular\b', 'Angular'), ('\bexpress\b', 'Express'), ('\bfastapi\b|\bflask\b|\bdjango\b', 'Python Web'),
        ('\bprisma\b', 'Prisma'), ('\bsupabase\b', 'Supabase'), ('\bdrizzle\b', 'Drizzle'), ('\btailwind\b', 'TailwindCSS'), ('\btrpc\b', 'tRPC'), ('\bgraphql\b', 'GraphQL'), ('\bwebpack\b', 'Webpack'), ('\bdocker\b', 'Docker'), ('\bkubernetes\b|\bk8s\b', 'Kubernetes'), ('\bpostgres\b|\bpg\b', 'PostgreSQL'), ('\bmongodb\b|\bmongoose\b', 'MongoDB'), ('\bredis\b', 'Redis'),
        ('\btypescript\b|\.tsx?\b', 'TypeScript'), ('\bpython\b|import numpy|import pandas', 'Python'), ('\brust\b|\bcargo\b', 'Rust'), ('\bgolang\b|\bgo\b', 'Go')) SELECT DISTINCT session_id, technology FROM messages, t WHERE regexp_matches(content, '(?i)' || p)""",
    "module_types": r"""WITH p AS (SELECT page_id, lower(url) AS u FROM pages) SELECT page_id, CASE WHEN regexp_matches(u, '\.test\.|\.spec\.|__tests__') THEN 'test' WHEN regexp_matches(u, 'config|settings|\.env') THEN 'config'
        WHEN regexp_matches(u, 'components?/|\.tsx$') OR page_id % 5 = 0 THEN 'component' WHEN regexp_matches(u, 'service|api|client|fetch|http') THEN 'service' WHEN regexp_matches(u, 'util|helper|lib/|shared') OR page_id % 2 = 0 THEN 'util' ELSE 'unknown' END AS module_type FROM p""",
    "inferred_roles": f"WITH {MESSAGES} SELECT session_id, message_index, ['user', 'assistant'][message_index % 2 + 1] AS inferred, ['user', 'assistant'][message_index % 2 + 1] = role AS agrees FROM messages",
    "token_warnings": """WITH l(platform, most) AS (VALUES ('claude', 180000), ('chatgpt', 100000), ('gemini', 900000), ('grok', 100000), ('perplexity', 60000), ('deepseek', 100000), ('other', 80000)),
        d AS (SELECT ['claude', 'chatgpt', 'gemini', 'grok', 'perplexity', 'deepseek', 'other'][doc_id % 7 + 1] AS platform, lang, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL)
        SELECT platform, lang, chars, ceil(chars / 4e0)::BIGINT AS tokens, floor(ceil(chars / 4e0) * 100 / most + 0.5e0)::BIGINT AS percent, CASE WHEN ceil(chars / 4e0) >= most THEN 'over' WHEN ceil(chars / 4e0) >= 0.8e0 * most THEN 'large' END AS level FROM d JOIN l USING (platform)""",
    "fuzzy_matches": rf"""WITH {MESSAGES}, f AS (SELECT session_id, message_index, content[:80] AS c, lead(content) OVER (PARTITION BY session_id ORDER BY message_index) AS after FROM messages WHERE content <> ''),
        w AS (SELECT *, list_filter(string_split_regex(lower(c), '\W+'), lambda w: length(w) > 4) AS words FROM f WHERE after IS NOT NULL)
        SELECT session_id, message_index, length(words) = 0 OR length(list_filter(words, lambda w: contains(lower(after), w))) >= 0.6e0 * length(words) AS kept FROM w""",
    "last_chunks": "SELECT label::BIGINT AS session_id, vec_id AS chunk_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id // 10 DESC, vec_id DESC) <= 15",
    "focused_context": f"""WITH {CHUNKS}, s AS (SELECT *, (chunk_id * 37 % 101) / 100e0 AS score FROM chunks WHERE text IS NOT NULL),
        r AS (SELECT *, CASE WHEN has_code THEN row_number() OVER (PARTITION BY session_id, has_code ORDER BY score DESC, chunk_id) ELSE row_number() OVER (PARTITION BY session_id, has_code ORDER BY message_index, chunk_id) END AS place FROM s WHERE score >= 0.5e0)
        SELECT session_id, has_code, place, md5(CASE WHEN has_code THEN text[:2000] ELSE text[:1500] END) AS md5 FROM r WHERE place <= CASE WHEN has_code THEN 5 ELSE 10 END""",
    "exported_markdown": f"WITH {MESSAGES} SELECT session_id, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY message_index) AS text FROM messages GROUP BY session_id",
    "exported_csv": f"""WITH {MESSAGES}, q AS (SELECT session_id, message_index, role, coalesce(content, '') AS c FROM messages)
        SELECT session_id, 'index,role,content' || chr(13) || chr(10) || string_agg(message_index || ',' || role || ',' || CASE WHEN regexp_matches(c, '[",\r\n]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END, chr(13) || chr(10) ORDER BY message_index) AS text FROM q GROUP BY session_id""",
    "sliding_limits": "WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events), n AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM e) SELECT event_id, n, n <= 3 AS ok FROM n",
}

QUERIES = {name: globals()[name] for name in ORACLES}


# -- pages and billing


def page_texts(spark, sf_dir):
    from threadlake.sources.files import html_text

    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


def _billing(spark, sf_dir):
    names = F.array(*map(F.lit, ("activated", "charged", "cancelled", "payment_failed", "expired")))
    o = orders(spark, sf_dir)
    return o.select((F.col("o_orderkey") % 5000).alias("event_id"), F.col("o_custkey").alias("subscription_id"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("event"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.timestamp_add("DAY", F.lit(30), "o_orderdate").alias("period_end"))


def subscription_states(spark, sf_dir):
    from threadlake.operators.subscriptions import states

    found = states(_billing(spark, sf_dir), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    return found.select("subscription_id", "plan", "status", F.col("at.o_orderkey").alias("order_key"))


def live_cache(spark, sf_dir):
    from threadlake.operators.subscriptions import alive

    at = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "ts")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", at.alias("at"))
    return alive(e, F.lit(1705276800), 86400, "user_id", 3).select("id", "user_id")


def allowed_requests(spark, sf_dir):
    from threadlake.operators.subscriptions import with_allowance

    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("at"), F.col("event_id").alias("id"))
    plans = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 5000, "pro").otherwise("trial").alias("plan"))
    return with_allowance(e, plans, {"free": 5, "trial": 8, "pro": 20}, "event_type").select("id", "plan", "allowed", "used")


def event_bursts(spark, sf_dir):
    from threadlake.streaming.windows import debounced

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))
    return debounced(e, "12 hours").select("key", "n", "last_id")


def cooled_requests(spark, sf_dir):
    from threadlake.streaming.windows import cooled_down

    at = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "ts")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("count"))
    return cooled_down(e, 43200).select("id")


_BLOCKS = "</?(?:p|div|section|article|header|footer|nav|ul|ol|li|h[1-6]|table|tr|blockquote|main|aside)\\b[^>]*>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))


def _page_text() -> str:
    out = "regexp_replace(html, '<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<button\\b.*?</button\\s*>|<svg\\b.*?</svg\\s*>|<noscript\\b.*?</noscript\\s*>|<!--.*?-->', '', 'gis')"
    out = f"regexp_replace(regexp_replace({out}, '<br\\s*/?>', chr(10), 'gi'), '{_BLOCKS}', chr(10), 'gi')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'gs')"
    for entity, character in _ENTITIES:
        out = f"replace({out}, '{entity}', '{character}')"
    return f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


ORACLES |= {
    "event_bursts": """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events),
        b AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g) SELECT user_id AS key, count(*) AS n, last(event_id ORDER BY ts, event_id) AS last_id FROM b GROUP BY user_id, burst""",
    "cooled_requests": """WITH e AS (SELECT event_id, event_type, floor(epoch(ts))::BIGINT AS s, user_id FROM events), l AS (SELECT *, lag(s) OVER w AS was, lag(event_type) OVER w AS kind FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
        SELECT event_id AS id FROM l WHERE was IS NULL OR s - was >= 43200 OR kind <> event_type""",
    "page_texts": f"SELECT page_id, {_page_text()} AS text FROM pages",
    "subscription_states": """WITH b AS (SELECT o_orderkey % 5000 AS event_id, o_custkey AS s, ['activated', 'charged', 'cancelled', 'payment_failed', 'expired'][o_orderkey % 5 + 1] AS event, o_orderdate, o_orderkey FROM orders
            QUALIFY row_number() OVER (PARTITION BY o_orderkey % 5000 ORDER BY o_orderdate, o_orderkey) = 1),
        l AS (SELECT *, max(CASE WHEN event IN ('activated', 'charged') THEN o_orderdate + INTERVAL 30 DAY END) OVER (PARTITION BY s) AS paid FROM b),
        t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY s ORDER BY o_orderdate DESC, o_orderkey DESC, event_id DESC) = 1)
        SELECT s AS subscription_id, CASE WHEN event IN ('activated', 'charged', 'payment_failed') OR event = 'cancelled' AND paid > TIMESTAMP '1996-01-01' THEN 'pro' ELSE 'free' END AS plan,
        CASE event WHEN 'payment_failed' THEN 'past_due' WHEN 'cancelled' THEN 'cancelled' WHEN 'expired' THEN 'completed' ELSE 'active' END AS status, o_orderkey AS order_key FROM t""",
    "live_cache": "WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events) SELECT event_id AS id, user_id FROM e WHERE 1705276800 - s < 86400 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) <= 3",
    "allowed_requests": """WITH p AS (SELECT e.*, coalesce(CASE WHEN c_custkey IS NULL THEN NULL WHEN c_acctbal > 5000 THEN 'pro' ELSE 'trial' END, 'free') AS plan FROM events e LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 3 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, CASE plan WHEN 'free' THEN 5 WHEN 'trial' THEN 8 ELSE 20 END AS most FROM p) SELECT event_id AS id, plan, k <= most AS allowed, least(k, most) AS used FROM r""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
