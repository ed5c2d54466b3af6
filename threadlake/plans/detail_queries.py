"""Details of sessions, usage and reports by the surveyed rules, each with an oracle written on its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from threadlake.functions.text import any_of, stripped
from threadlake.operators import quality
from threadlake.plans.operator_oracles import CHUNKS, MESSAGES
from threadlake.plans.operator_queries import PLATFORMS, chunks, messages, orders
from threadlake.sources.tables import table

# FIXED values: shapes of titles that are tokens, references to something earlier, openers that are no request.
TOKEN_TITLES = [r"^[A-Za-z0-9+/=_-]{40,}$", r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$", r"^ey[A-Za-z0-9_-]{20,}"]
DANGLING = [r"(?i)\bthat (?:error|bug|issue|fix|problem)\b", r"(?i)\bthe (?:same|previous|above|earlier) (?:error|bug|issue|approach|fix|solution)\b", r"(?i)\bas (?:mentioned|discussed|noted) (?:above|before|earlier)\b", r"(?i)\bsame (?:issue|problem|error|bug) as\b", r"(?i)\bthis (?:same|exact) (?:error|bug|issue)\b"]
TRIVIAL = r"^(?i:ok|hi|hello|hey|say\s+(?:ok|hi|hello)|understand|read\s+(?:this|it|the)|look\s+at|check\s+(?:this|it)|continue|go\s+ahead)\b"
TECHNICAL = r"(?i)\b(?:fix|bug|error|build|deploy|implement|create|add|update|refactor|migrate|test|debug|api|function|component|route|endpoint|database|schema)\b"


def _texts(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))


def token_titles(spark, sf_dir):
    """Page paths as titles, and three made-up ones."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("title"))
    extra = spark.createDataFrame([(-1, "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"), (-2, "aa.bb.cc"), (-3, "A" * 41), (-4, "a plain title")], "page_id long, title string")
    return rows.unionByName(extra).select("page_id", any_of(stripped(F.col("title")), TOKEN_TITLES).alias("suspicious"))


def sidebar_matches(spark, sf_dir):
    """Sessions where 'the' is in the title, the platform's label or one of the last four messages."""
    m = _texts(spark, sf_dir)
    late = m.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("message_index")))).filter("r <= 4")
    hit = late.groupBy("session_id").agg(F.bool_or(F.lower("content").contains("the")).alias("in_text"))
    title = m.filter("role = 'user'").groupBy("session_id").agg(F.min_by(F.substring("content", 1, 72), "message_index").alias("title"))
    label = F.element_at(F.array(*map(F.lit, PLATFORMS)), (F.col("session_id") % 6 + 1).cast("int"))
    return hit.join(title, "session_id", "left").filter(F.col("in_text") | F.coalesce(F.lower("title").contains("the"), F.lit(False)) | label.contains("the")).select("session_id")


def unindexed_sessions(spark, sf_dir):
    manifest = table(spark, sf_dir, "conversations").filter("conv_id % 3 = 0").select(F.col("conv_id").alias("session_id")).distinct()
    sizes = _texts(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n")).filter("n >= 3")
    return sizes.join(manifest, "session_id", "left_anti")


def upload_candidates(spark, sf_dir):
    local = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    remote = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("session_id"))
    dead = orders(spark, sf_dir).filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("session_id"))
    fetched = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("session_id"))
    return reduce(lambda a, b: a.join(b, "session_id", "left_anti"), (remote, dead, fetched), local)


def sync_actions(spark, sf_dir):
    local = orders(spark, sf_dir).filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("mine"))
    remote = orders(spark, sf_dir).filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("theirs"))
    action = F.when(F.col("theirs").isNull(), "upload").when(F.col("mine").isNull(), "new").when(F.col("theirs") > F.col("mine"), "update").when(F.col("mine") > F.col("theirs"), "upload").otherwise("same")
    return local.join(remote, "id", "full_outer").select("id", action.alias("action"))


def users_of_month(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    usage = table(spark, sf_dir, "events").filter(F.date_format("ts", "yyyy-MM") == "2024-01").groupBy("user_id").agg(F.count("*").alias("used"))
    latest = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    return users.join(usage, "user_id", "left").join(latest, "user_id", "left").select("user_id", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("status", F.lit("none")).alias("status"))


def reconciled_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    counted = [e.filter(F.col("event_type") == t).groupBy("user_id", "month").agg(F.count("*").alias(t)) for t in ("view", "click", "purchase")]
    met = counted[0].join(counted[1], ["user_id", "month"], "full_outer").join(counted[2], ["user_id", "month"], "full_outer")
    return met.select("user_id", "month", F.greatest(*(F.coalesce(t, F.lit(0)) for t in ("view", "click", "purchase"))).alias("n"))


def messages_of_chunks(spark, sf_dir):
    """The messages that a session's chunks name, their places moved into the session; the last ten more if the chunks are fewer
    than five. Chunks that belong to another session are left out."""
    m = _texts(spark, sf_dir)
    n = m.groupBy("session_id").agg(F.count("*").alias("n"))
    c = chunks(spark, sf_dir).select(F.when(F.col("chunk_id") % 13 == 0, 9000001 + F.col("chunk_id") % 4).otherwise(F.col("chunk_id") % 37).alias("session_id"), F.col("message_index").alias("at"), F.when(F.col("chunk_id") % 11 == 0, -1).otherwise(0).alias("shift"))
    c = c.withColumn("owner", F.col("session_id") + F.col("shift")).filter("owner = session_id").select("session_id", "at")
    named = c.join(n, "session_id").select("session_id", F.greatest(F.lit(0), F.least("at", F.col("n") - 1)).alias("message_index")).distinct()
    few = n.join(c.groupBy("session_id").agg(F.count("*").alias("k")), "session_id", "left").filter("coalesce(k, 0) < 5")
    tail = m.join(few.select("session_id", "n"), "session_id").filter("message_index >= n - 10").select("session_id", "message_index")
    return m.select("session_id", "message_index", "role").join(named.union(tail).distinct(), ["session_id", "message_index"], "left_semi")


def quality_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 101).alias("score"))
    return d.agg(F.count("*").alias("total"), quality.rounded(F.avg("score")).alias("average"), F.min_by("doc_id", F.struct(-F.col("score"), "doc_id")).alias("best"), F.min_by("doc_id", F.struct("score", "doc_id")).alias("worst"))


def weakest_dimensions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 26).alias("survival"), (F.col("n_chars") % 21).alias("code"), (F.col("n_chars") % 16).alias("freshness"))
    return quality.weakest(d, {"survival": 25.0, "code": 20.0, "freshness": 15.0}).select("dimension", F.round("average", 6).alias("average"), F.round("share", 6).alias("share"))


def metric_averages(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).filter("r <= 200")
    return e.groupBy("event_type").agg(quality.rounded(F.avg("value")).alias("average"), quality.rounded(F.min("value")).alias("least"), quality.rounded(F.max("value")).alias("most"), F.count("*").alias("n"))


def capture_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("r <= 20")
    rates = e.groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("event_type") != "error").cast("int")).alias("success"), F.avg((F.col("value") > 5).cast("int")).alias("assistant"))
    return rates.select("user_id", "n", F.round("success", 6).alias("success"), F.round("assistant", 6).alias("assistant"), ((F.col("n") >= 8) & (F.col("success") < 0.6) & (F.col("assistant") < 0.5)).alias("alert"))


def counts_of_platforms(spark, sf_dir):
    names = spark.createDataFrame([(p,) for p in [*PLATFORMS, "never_used"]], "platform string")
    n = table(spark, sf_dir, "documents").groupBy(F.element_at(F.array(*map(F.lit, PLATFORMS)), (F.col("doc_id") % 6 + 1).cast("int")).alias("platform")).agg(F.count("*").alias("n"))
    return names.join(n, "platform", "left").select("platform", F.coalesce("n", F.lit(0)).alias("n"))


def hit_previews(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("score", F.col("chunk_id") * 37 % 101)
    return c.groupBy("session_id").agg(F.max("score").alias("score"), F.substring(F.max_by("text", F.struct("score", -F.col("chunk_id"))), 1, 60).alias("preview"))


def evolving_goals(spark, sf_dir):
    """Of a session's user messages at the start, quarters and end the last one of 31 to 799 characters, or else the last one."""
    u = _texts(spark, sf_dir).filter("role = 'user'")
    w = Window.partitionBy("session_id")
    u = u.withColumn("i", F.row_number().over(w.orderBy("message_index")) - 1).withColumn("n", F.count("*").over(w))
    places = [F.lit(0), F.floor(F.col("n") * 0.25), F.floor(F.col("n") * 0.5), F.floor(F.col("n") * 0.75), F.col("n") - 1]
    picked = reduce(lambda a, b: a | b, [F.col("i") == p for p in places]) & (F.length("content") > 30) & (F.length("content") < 800) & ~F.col("content").startswith("You are a") & ~F.col("content").startswith("Read every file")
    best = u.groupBy("session_id").agg(F.max_by("content", F.when(picked, F.col("i"))).alias("goal"), F.max(F.when(picked, F.col("i"))).alias("at"), F.max_by("content", "i").alias("last"))
    return best.select("session_id", F.substring(F.when(F.col("at").isNotNull(), F.col("goal")).otherwise(F.col("last")), 1, 400).alias("goal"))


def looked_back(spark, sf_dir):
    """The last four messages, and up to two before each that speaks of something earlier."""
    m = _texts(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("message_index")
    m = m.withColumn("tail", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("message_index"))) <= 4).withColumn("asks", F.col("tail") & any_of(F.col("content"), DANGLING))
    wanted = F.coalesce(F.lead("asks", 1).over(w), F.lit(False)) | F.coalesce(F.lead("asks", 2).over(w), F.lit(False))
    return m.withColumn("wanted", wanted).filter("tail OR wanted").select("session_id", "message_index")


def head_and_tail(spark, sf_dir, most: int = 800):
    """The first messages within a fifth of the characters, the last ones within the rest, and a row for the gap."""
    m = _texts(spark, sf_dir).withColumn("size", F.length("content"))
    own = Window.partitionBy("session_id")
    m = m.withColumn("total", F.sum("size").over(own)).withColumn("before", F.sum("size").over(own.orderBy("message_index"))).withColumn("after", F.sum("size").over(own.orderBy(F.desc("message_index"))))
    head, all_of = F.col("before") <= most // 5, F.col("total") <= most
    side = F.when(all_of, "whole").when(head, "head").when(F.col("after") <= most - most // 5, "tail").otherwise("gap")
    m = m.withColumn("side", side)
    gaps = m.filter("side = 'gap'").groupBy("session_id").agg(F.min("message_index").alias("message_index"), F.concat(F.lit("[... "), F.count("*").cast("string"), F.lit(" messages truncated ...]")).alias("content"))
    return m.filter("side <> 'gap'").select("session_id", "message_index", "side").unionByName(gaps.select("session_id", "message_index", F.col("content").alias("side")))


def cutoff_scores(spark, sf_dir):
    m = _texts(spark, sf_dir).withColumn("score", F.length("content"))
    own = Window.partitionBy("session_id")
    m = m.withColumn("r", F.row_number().over(own.orderBy(F.desc("score"), "message_index"))).withColumn("n", F.count("*").over(own))
    return m.filter("r = greatest(0, floor(n * 0.25) - 1) + 1").select("session_id", F.col("score").cast("bigint").alias("cutoff"))


def tail_with_neighbours(spark, sf_dir):
    m = _texts(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("message_index")
    late = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy(F.desc("message_index")))
    m = m.withColumn("hit", (F.col("role") == "assistant") & (late <= 10))
    near = F.coalesce(F.lag("hit").over(w), F.lit(False)) | F.coalesce(F.lead("hit").over(w), F.lit(False))
    return m.withColumn("near", near).filter("hit OR near").select("session_id", "message_index")


def first_goals(spark, sf_dir):
    u = _texts(spark, sf_dir).filter("role = 'user'").withColumn("t", stripped(F.col("content")))
    short = (F.length("t") < 50) & ~F.col("t").rlike(TECHNICAL)
    trivial = F.col("t").rlike(TRIVIAL) & (F.length("t") < 80)
    return u.filter(~short & ~trivial).groupBy("session_id").agg(F.substring(F.min_by("t", "message_index"), 1, 600).alias("goal"))


def substantive_ends(spark, sf_dir):
    m = _texts(spark, sf_dir).filter(F.length("content") >= 20).withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("message_index")))).filter("r <= 3")
    joined = m.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "content"))), lambda x: x["content"]), "\n").alias("text"))
    return joined.select("session_id", F.md5("text").alias("md5"))


def plans_of_users(spark, sf_dir):
    """The latest subscription; one that was cancelled counts until its period ends."""
    o = orders(spark, sf_dir).withColumn("ends", F.timestamp_add("DAY", F.lit(400), "o_orderdate")).filter((F.col("o_orderstatus") != "F") | (F.col("ends") > F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")))
    latest = o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("subscription_id"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.join(latest, "user_id", "left").select("user_id", F.coalesce("subscription_id", F.lit(-1)).alias("subscription_id"))


def scored_outputs(spark, sf_dir):
    """Three outputs of each session: all messages, those of the second half, and the last two."""
    m = messages(spark, sf_dir)
    t = _texts(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    line = F.concat(F.lit("**"), F.initcap("role"), F.lit(":** "), F.col("content"))
    keep = {1: F.lit(True), 2: F.col("message_index") * 2 >= F.col("n"), 3: F.col("message_index") >= F.col("n") - 2}
    outputs = [t.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(k, F.struct("message_index", line.alias("l"))))), lambda x: x["l"]), "\n").alias("output")).withColumn("tier", F.lit(n)).withColumn("top_k", F.lit(12)) for n, k in keep.items()]
    return quality.scores(m, outputs[0].unionByName(outputs[1]).unionByName(outputs[2]))


_M = f"{MESSAGES}, m AS (SELECT session_id, message_index, role, coalesce(content, '') AS content FROM messages)"
_ANY = lambda patterns, text: " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns)
_R1 = "floor({} * 10 + 0.5e0) / 10"
_COUNT = lambda pattern, text="output": f"length(regexp_extract_all({text}, '{pattern}'))"
_MARKS = lambda role: "greatest(" + ", ".join(_COUNT(p) for p in quality.ROLE_MARKS[role]) + ")"
_SIGNS = lambda text: "(" + " + ".join(_COUNT(p.replace("'", "''"), text) for p in quality.SIGNALS) + ")"
ORACLES = {
    "token_titles": f"""WITH t AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS title FROM pages UNION ALL SELECT * FROM (VALUES (-1, 'eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9'), (-2, 'aa.bb.cc'), (-3, repeat('A', 41)), (-4, 'a plain title')) v)
        SELECT page_id, {_ANY(TOKEN_TITLES, 'trim(title)')} AS suspicious FROM t""",
    "sidebar_matches": f"""WITH {_M}, late AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) <= 4), s AS (SELECT DISTINCT session_id FROM m)
        SELECT session_id FROM s WHERE EXISTS (SELECT 1 FROM late l WHERE l.session_id = s.session_id AND contains(lower(l.content), 'the'))
        OR contains(lower((SELECT arg_min(content, message_index) FROM m WHERE m.session_id = s.session_id AND role = 'user')[:72]), 'the')""",
    "unindexed_sessions": f"WITH {_M} SELECT session_id, count(*) AS n FROM m WHERE session_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 3 = 0) GROUP BY session_id HAVING count(*) >= 3",
    "upload_candidates": """SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND conv_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AND conv_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""",
    "sync_actions": """WITH x AS (SELECT o_custkey AS id, max(o_orderdate) FILTER (o_orderstatus = 'O') AS a, max(o_orderdate) FILTER (o_orderstatus = 'F') AS b FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_custkey)
        SELECT id, CASE WHEN a IS NULL THEN 'new' WHEN b > a THEN 'update' WHEN a = b THEN 'same' ELSE 'upload' END AS action FROM x""",
    "users_of_month": "SELECT c_custkey AS user_id, (SELECT count(*) FROM events WHERE user_id = c_custkey AND ts >= '2024-01-01' AND ts < '2024-02-01') AS used, coalesce((SELECT first(o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) FROM orders WHERE o_custkey = c_custkey), 'none') AS status FROM customer",
    "reconciled_history": "WITH c AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL) SELECT user_id, month, max(n) AS n FROM c GROUP BY ALL",
    "messages_of_chunks": f"""WITH {_M}, s AS (SELECT session_id, count(*) AS n FROM m GROUP BY session_id), c AS (SELECT CASE WHEN vec_id % 13 = 0 THEN 9000001 + vec_id % 4 ELSE vec_id % 37 END AS session_id, vec_id // 10 AS at_i FROM embeddings WHERE vec_id % 11 <> 0), k AS (SELECT session_id, count(*) AS k FROM c GROUP BY session_id)
        SELECT m.session_id, m.message_index, m.role FROM m JOIN s USING (session_id) LEFT JOIN k USING (session_id) WHERE (coalesce(k.k, 0) < 5 AND m.message_index >= n - 10)
        OR m.message_index IN (SELECT CASE WHEN at_i < n THEN at_i ELSE n - 1 END FROM c WHERE c.session_id = m.session_id)""",
    "quality_report": f"WITH d AS (SELECT doc_id, n_chars % 101 AS score FROM documents) SELECT count(*) AS total, {_R1.format('avg(score)')} AS average, first(doc_id ORDER BY score DESC, doc_id) AS best, first(doc_id ORDER BY score, doc_id) AS worst FROM d",
    "weakest_dimensions": "WITH d AS (SELECT 'survival' AS dimension, avg(doc_id % 26) AS a, 25e0 AS most FROM documents UNION ALL SELECT 'code', avg(n_chars % 21), 20 FROM documents UNION ALL SELECT 'freshness', avg(n_chars % 16), 15 FROM documents) SELECT dimension, round(a, 6) AS average, round(a / most, 6) AS share FROM d",
    "metric_averages": f"WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200) SELECT event_type, {_R1.format('avg(value)')} AS average, {_R1.format('min(value)')} AS least, {_R1.format('max(value)')} AS most, count(*) AS n FROM e GROUP BY event_type",
    "capture_rates": """WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20), r AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') / count(*) AS s, count(*) FILTER (value > 5) / count(*) AS a FROM e GROUP BY user_id)
        SELECT user_id, n, round(s, 6) AS success, round(a, 6) AS assistant, n >= 8 AND s < 0.6e0 AND a < 0.5e0 AS alert FROM r""",
    "counts_of_platforms": "WITH p AS (SELECT unnest(['chatgpt', 'claude', 'grok', 'gemini', 'deepseek', 'perplexity', 'never_used']) AS platform, unnest(range(0, 7)) AS i) SELECT platform, (SELECT count(*) FROM documents WHERE doc_id % 6 = i) AS n FROM p",
    "hit_previews": f"WITH {CHUNKS}, s AS (SELECT *, chunk_id * 37 % 101 AS score FROM chunks) SELECT session_id, max(score) AS score, first(text ORDER BY score DESC, chunk_id)[:60] AS preview FROM s GROUP BY session_id",
    "evolving_goals": f"""WITH {_M}, u AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_index) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM m WHERE role = 'user'),
        g AS (SELECT session_id, content, i FROM u WHERE i IN (0, n // 4, n // 2, (3 * n) // 4, n - 1) AND length(content) BETWEEN 31 AND 799 AND NOT starts_with(content, 'You are a') AND NOT starts_with(content, 'Read every file'))
        SELECT session_id, coalesce((SELECT arg_max(content, i) FROM g WHERE g.session_id = u.session_id), arg_max(content, i))[:400] AS goal FROM u GROUP BY session_id""",
    "looked_back": f"""WITH {_M}, t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_index) AS i, row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) <= 4 AS late, {_ANY(DANGLING, 'content')} AS asks FROM m)
        SELECT session_id, message_index FROM t WHERE late OR EXISTS (SELECT 1 FROM t o WHERE o.session_id = t.session_id AND o.late AND o.asks AND o.i - t.i IN (1, 2))""",
    "head_and_tail": f"""WITH {_M}, s AS (SELECT a.session_id, a.message_index, sum(length(b.content)) AS total, sum(length(b.content)) FILTER (b.message_index <= a.message_index) AS before, sum(length(b.content)) FILTER (b.message_index >= a.message_index) AS after FROM m a JOIN m b ON a.session_id = b.session_id GROUP BY ALL),
        d AS (SELECT session_id, message_index, CASE WHEN total <= 800 THEN 'whole' WHEN before <= 160 THEN 'head' WHEN after <= 640 THEN 'tail' ELSE 'gap' END AS side FROM s)
        SELECT session_id, message_index, side FROM d WHERE side <> 'gap' UNION ALL SELECT session_id, min(message_index), '[... ' || count(*) || ' messages truncated ...]' FROM d WHERE side = 'gap' GROUP BY session_id""",
    "cutoff_scores": f"WITH {_M}, l AS (SELECT session_id, list(length(content) ORDER BY length(content) DESC) AS l FROM m GROUP BY session_id) SELECT session_id, l[greatest(0, len(l) // 4 - 1) + 1] AS cutoff FROM l",
    "tail_with_neighbours": f"""WITH {_M}, i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_index) AS i FROM m), h AS (SELECT session_id, i FROM i WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i DESC) <= 10)
        SELECT session_id, message_index FROM i WHERE EXISTS (SELECT 1 FROM h WHERE h.session_id = i.session_id AND abs(h.i - i.i) <= 1)""",
    "first_goals": rf"""WITH {_M}, u AS (SELECT session_id, message_index, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM m WHERE role = 'user')
        SELECT session_id, arg_min(t, message_index)[:600] AS goal FROM u WHERE (length(t) >= 50 OR regexp_matches(t, '{TECHNICAL}')) AND (length(t) >= 80 OR NOT regexp_matches(t, '{TRIVIAL}')) GROUP BY session_id""",
    "substantive_ends": f"WITH {_M}, l AS (SELECT * FROM m WHERE length(content) >= 20 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) <= 3) SELECT session_id, md5(string_agg(content, chr(10) ORDER BY message_index)) AS md5 FROM l GROUP BY session_id",
    "plans_of_users": "SELECT c_custkey AS user_id, coalesce((SELECT first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus <> 'F' OR o_orderdate + INTERVAL 400 DAY > TIMESTAMP '1996-06-01')), -1) AS subscription_id FROM customer",
    "scored_outputs": f"""WITH {_M}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY message_index) AS i, row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) AS back, '**' || upper(role[1]) || role[2:] || ':** ' || content AS line FROM m),
        t(tier) AS (VALUES (1), (2), (3)), o AS (SELECT session_id, tier, any_value(n) AS n, count(*) FILTER (role IN ('user', 'assistant')) AS valid, sum({_COUNT('```', 'content')}) AS fences, sum(CASE WHEN i <= 50 THEN {_SIGNS('content')} ELSE 0 END) AS signals, list(trim(content[:60])) FILTER (back <= 6) AS tail,
            coalesce(string_agg(line, chr(10) ORDER BY message_index) FILTER (tier = 1 OR tier = 2 AND message_index * 2 >= n OR tier = 3 AND message_index >= n - 2), '') AS output FROM n, t GROUP BY session_id, tier),
        k AS (SELECT *, {_MARKS('user')} + {_MARKS('assistant')} AS kept, greatest({_COUNT('```')} // 2, {_COUNT('(?i)<code[^>]*>')} + {_COUNT('(?i)<(?:file|snippet)' + chr(92) + 's')}) AS blocks, {_COUNT('```')} % 2 AS odd, length(list_filter(tail, lambda f: f = '' OR contains(output, f))) AS present, {_SIGNS('output')} AS found FROM o),
        p AS (SELECT session_id, tier, {_R1.format('least(n, kept) / n * 25')} AS survival, {_R1.format('greatest(0e0, CASE WHEN fences // 2 > 0 THEN least(1e0, blocks / (fences // 2)) * 20 ELSE 20e0 END - 5 * odd)')} AS code, {_R1.format('valid / n * 15')} AS roles,
            CASE WHEN present >= 6 THEN 15e0 WHEN present >= 4 THEN 10e0 WHEN present >= 2 THEN 5e0 ELSE 0e0 END AS freshness, CASE WHEN signals > 0 THEN {_R1.format('least(signals, found) / signals * 15')} ELSE 15e0 END AS retention,
            CASE tier WHEN 1 THEN 10e0 WHEN 2 THEN CASE WHEN kept / n >= 0.9e0 THEN 8e0 WHEN kept / n >= 0.7e0 THEN 10e0 WHEN kept / n >= 0.5e0 THEN 6e0 ELSE 3e0 END ELSE 7e0 END AS compression FROM k),
        s AS (SELECT *, floor(survival + code + roles + freshness + retention + compression + 0.5e0)::BIGINT AS score FROM p)
        SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Acceptable' WHEN score >= 40 THEN 'Poor' ELSE 'Failed' END AS grade FROM s""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
