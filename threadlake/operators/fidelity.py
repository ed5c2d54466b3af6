"""How much of a session a shortened output keeps, what it lost, and signals of single messages.

Messages have (session_id, message_index, role, content); a null content counts as empty, a null session takes no part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.functions.keeping import once
from threadlake.functions.text import stripped
from threadlake.operators.sessions import like_enough, long_words
from threadlake.operators.summaries import clauses, matches

# FIXED values: weights, grades, steps of compression, patterns and caps of what an output should keep.
WEIGHTS = {"roles": 0.20, "code": 0.25, "semantic": 0.25, "tasks": 0.15, "compression": 0.15}
GRADES = [(90, "Excellent"), (70, "Good"), (50, "Degraded")]
KEPT_STEPS = [(0.4, 100), (0.2, 75), (0.1, 50)]
FACT = r"(?i)must|cannot|requires|version|api key|endpoint|port"
CHOICE = r"(?i)instead of|chose|decided|trade.off|going with|opted for|let.s use|sticking with|switching to"
DONE = r"(?i)here.s|done|created|fixed|implemented|finished"
OPEN = r"(?i)todo|next step|remaining|still need|will need"
ITEM_CAPS = {"fact": 8, "decision": 8, "completed": 12, "pending": 10}
DECISION_SIGNALS = [
    r"(?i)\bwe decided\b", r"(?i)\bdecided to\b", r"(?i)\bgoing with\b", r"(?i)\bopted for\b", r"(?i)\bwe('?ll| will) use\b", r"(?i)\bchose to\b", r"(?i)\bswitching to\b", r"(?i)\bmigrating to\b", r"(?i)\bbest approach\b",
    r"(?i)\bthe approach is\b", r"(?i)\bwe use\b", r"(?i)\bwent with\b", r"(?i)\bshould use\b", r"(?i)\bmust use\b", r"(?i)\bthe solution\b", r"(?i)\barchitecture\b", r"(?i)\bthe plan\b",
]
ERROR_SIGNALS = [
    r"\b(?:Traceback|TypeError|ValueError|ReferenceError|SyntaxError|RuntimeError)\b", r"\bat\s+\w[\w.]*\s+\([^)]+:\d+:\d+\)", r"\bError:\s+\S", r"\bException\s+in\s+thread\b", r"(?i)\bthe issue was\b", r"(?i)\broot cause\b", r"(?i)\bbug was caused\b",
    r"(?i)\bfixed by\b", r"(?i)\bcaused by\b", r"(?i)\bturned out (?:to be|that)\b", r"(?i)\bregression\b", r"(?i)\b(?:race condition|deadlock|memory leak)\b",
]
GOAL_SIGNALS = [r"(?i)\bthe goal\b", r"(?i)\bour goal\b", r"(?i)\bwe want to\b", r"(?i)\bwe need to\b", r"(?i)\bwe('?re| are) building\b", r"(?i)\bnext step\b", r"(?i)\bthe plan\b"]
BUCKET_DECISIONS = (
    r"(?i)\b(?:decided|decision|conclusion|agreed|agree|resolution|chose|choose|switched|switch|fixed|resolved|approach|selected|determined|confirmed|plan|strategy|architecture|refactor|migrate|adopted|pivoted|went with|settled on|root cause"
    r"|bug|issue|error|problem)\b"
)
FENCE = r"(?s)(```.*?```)"


def _blocks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(FENCE), 1), stripped)


def _percent(found: Column, of: Column) -> Column:
    return F.floor(found / of * 100 + 0.5)


def _keyed(outputs: DataFrame) -> DataFrame:
    """Each different row of (session_id, tier, output) once, under a key of its own."""
    rows = outputs.select("session_id", "tier", F.coalesce("output", F.lit("")).alias("output"))
    return once(rows.withColumn("key", F.md5(F.to_json(F.struct("session_id", "tier", "output"), {"ignoreNullFields": "false"}))).dropDuplicates(["key"]))


def _items(m: DataFrame) -> DataFrame:
    """(session_id, items): the goal, and up to the caps the first facts, decisions, completed and pending things."""
    c = F.col("content")
    unit = lambda section, units, keep: F.filter(F.transform(units, lambda s, i: F.struct(F.lit(section).alias("section"), i.alias("pos"), s.alias("text"))), lambda x: keep(x["text"]))
    none = F.array().cast("array<struct<section:string,pos:int,text:string>>")
    long = lambda p: lambda s: (F.length(s) > 15) & s.rlike(p)
    named = lambda s: F.length(s) > 10
    found = F.concat(
        unit("fact", clauses(c), long(FACT)),
        unit("decision", clauses(c), long(CHOICE)),
        F.when((F.col("role") == "assistant") & c.rlike(DONE), unit("completed", F.array(stripped(F.element_at(F.split(c, "\n"), 1))), named)).otherwise(none),
        F.when(c.rlike(OPEN), unit("pending", F.array(F.element_at(clauses(c), 1)), named)).otherwise(none),
    )
    rows = m.select("session_id", "message_index", F.explode(found).alias("x")).select("session_id", "message_index", "x.*")
    place = F.row_number().over(Window.partitionBy("session_id", "section").orderBy("message_index", "pos", "text"))
    cap = reduce(lambda e, s: e.when(F.col("section") == s, ITEM_CAPS[s]), ITEM_CAPS, F.when(F.lit(False), 0))
    few = rows.withColumn("place", place).filter(F.col("place") <= max(ITEM_CAPS.values())).filter(F.col("place") <= cap).select("session_id", "section", "place", "text")
    goal = m.groupBy("session_id").agg(F.min(F.when(F.col("role") == "user", F.struct("message_index", F.substring("content", 1, 600).alias("text")))).alias("x"))
    goal = goal.select("session_id", F.lit("goal").alias("section"), F.lit(1).alias("place"), "x.text").filter("text <> ''")
    return few.unionByName(goal).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("section", "place", "text"))).alias("items"))


def _met(m: DataFrame, outs: DataFrame) -> DataFrame:
    """Outputs with each item of their session and whether it is kept: items are few, so an output is not copied. An output
    is put in small letters before the join, once and not for each word of each item."""
    lower = outs.withColumn("_lower", F.lower("output"))
    kept = F.transform("items", lambda x: F.struct(x["section"].alias("section"), x["place"].alias("place"), x["text"].alias("text"), like_enough(x["words"], F.col("_lower")).alias("kept")))
    items = _items(m).withColumn("items", F.transform("items", lambda x: x.withField("words", long_words(x["text"]))))
    return lower.join(items, "session_id", "left").withColumn("items", F.coalesce(kept, F.array().cast("array<struct<section:string,place:int,text:string,kept:boolean>>"))).drop("_lower")


def _code(m: DataFrame, outs: DataFrame) -> DataFrame:
    """(key, session_id, tier, code, n, first, kept): each different block of a session, against each of its outputs."""
    blocks = m.select("session_id", "message_index", F.posexplode(_blocks(F.col("content"))).alias("pos", "block"))
    blocks = blocks.groupBy("session_id", F.md5("block").alias("code")).agg(F.count("*").alias("n"), F.min(F.struct("message_index", "pos", F.substring("block", 1, 40).alias("head"))).alias("first"))
    there = outs.select("key", F.explode(F.array_distinct(F.transform(_blocks(F.col("output")), F.md5))).alias("code")).withColumn("kept", F.lit(True))
    return outs.select("key", "session_id", "tier").join(blocks, "session_id").join(there, ["key", "code"], "left")


def _messages(messages: DataFrame) -> DataFrame:
    return messages.filter("session_id IS NOT NULL").select("session_id", "message_index", "role", F.coalesce("content", F.lit("")).alias("content"))


def fidelity(messages: DataFrame, outputs: DataFrame) -> DataFrame:
    """(session_id, tier, roles, code, semantic, tasks, compression, total, grade) of outputs (session_id, tier, output).

    A role counts where the output's n-th line of a role has that of the session's n-th message; without such lines it is
    50. Blocks of code count if the output has the same one (by 128 bits; a fence over two messages is none), goal, facts,
    decisions and tasks if most of their longer words occur. An empty output scores 0 throughout. Repeated rows are scored
    once, different outputs of one tier each for itself; an output without messages is scored against none."""
    m, outs = _messages(messages), _keyed(outputs)
    whole = m.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    user = lambda s: s.startswith("User:")
    lines = F.filter(F.split("output", "\n"), lambda s: user(s) | s.startswith("Assistant:"))
    numbered = m.select("session_id", (F.col("role") == "user").alias("user"), (F.row_number().over(Window.partitionBy("session_id").orderBy("message_index")) - 1).alias("i"))
    told = outs.select("key", "session_id", F.posexplode(F.transform(lines, user)).alias("i", "said"))
    right = told.join(numbered, ["session_id", "i"]).filter(F.col("said").eqNullSafe(F.coalesce("user", F.lit(False)))).groupBy("key").agg(F.count("*").alias("right"))
    code = _code(m, outs).groupBy("key").agg(F.sum("n").alias("had"), F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("held"))
    met = _met(m, outs).join(whole, "session_id", "left").join(right, "key", "left").join(code, "key", "left")
    of = lambda *names: F.filter("items", lambda x: x["section"].isin(*names))
    share = lambda items: F.when(F.size(items) == 0, 100).otherwise(_percent(F.size(F.filter(items, lambda x: x["kept"])), F.size(items)))
    ratio = F.when(F.col("chars") > 0, F.length("output") / F.col("chars")).otherwise(1.0)
    parts = {
        "roles": F.when(F.size(lines) == 0, 50).otherwise(_percent(F.coalesce("right", F.lit(0)), F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))),
        "code": F.when(F.col("had").isNull(), 100).otherwise(_percent(F.col("held"), F.col("had"))),
        "semantic": share(of("goal", "fact", "decision")),
        "tasks": share(of("completed", "pending")),
        "compression": reduce(lambda e, s: e.when(ratio >= s[0], s[1]), KEPT_STEPS[1:], F.when(ratio >= KEPT_STEPS[0][0], KEPT_STEPS[0][1])).otherwise(25),
    }
    empty = stripped(F.col("output")) == ""
    rows = met.select("session_id", "tier", *(F.when(empty, 0).otherwise(c).cast("long").alias(name) for name, c in parts.items()))
    total = F.floor(reduce(lambda a, b: a + b, [F.col(name) * w for name, w in WEIGHTS.items()]) + 0.5).cast("long")
    grade = F.coalesce(*(F.when(F.col("total") >= least, F.lit(name)) for least, name in GRADES), F.lit("Fail"))
    return rows.withColumn("total", total).withColumn("grade", grade)


def lost_items(messages: DataFrame, outputs: DataFrame) -> DataFrame:
    """(session_id, tier, section, place, text): what fidelity doesn't find in an output that isn't empty. Code is numbered
    by its first place; a block that a session has several times is one row."""
    m, outs = _messages(messages), _keyed(outputs).filter(stripped(F.col("output")) != "")
    said = _met(m, outs).select("session_id", "tier", F.explode(F.filter("items", lambda x: ~x["kept"])).alias("x"))
    said = said.select("session_id", "tier", "x.section", F.col("x.place").cast("long").alias("place"), F.substring("x.text", 1, 60).alias("text"))
    code = _code(m, outs).filter("kept IS NULL")
    return said.unionByName(code.select("session_id", "tier", F.lit("code").alias("section"), (F.col("first.message_index") * 1000 + F.col("first.pos")).cast("long").alias("place"), F.col("first.head").alias("text")))


def signal_scores(messages: DataFrame, goal: str = "") -> DataFrame:
    """(session_id, message_index, score, top): errors .30, decisions .25, goals .15, code .15, length up to .07, words of the
    goal and lateness .08 each. top: the best quarter of a session, five at least, the earlier one first among equals. Texts
    are scored before rows are dealt by session."""
    c = F.col("content")
    signal = F.when(matches(c, ERROR_SIGNALS), 0.30).otherwise(0.0) + F.when(matches(c, DECISION_SIGNALS), 0.25).otherwise(0.0) + F.when(matches(c, GOAL_SIGNALS), 0.15).otherwise(0.0)
    signal = signal + F.when(c.rlike(FENCE), 0.15).otherwise(0.0) + F.least(F.lit(0.07), F.length(c) / 8000.0)
    words = F.filter(F.split(F.lower(F.lit(goal)), r"\W+"), lambda w: F.length(w) > 3)
    hits = F.size(F.filter(words, lambda w: F.lower(c).contains(w)))
    boost = F.when(F.size(words) > 0, 0.08 * (hits / F.size(words))).otherwise(0.0)
    rows = _messages(messages).select("session_id", "message_index", F.least(F.lit(0.92), signal).alias("signal"), boost.alias("boost"))
    own = Window.partitionBy("session_id")
    rows = rows.withColumn("i", F.row_number().over(own.orderBy("message_index")) - 1).withColumn("n", F.count("*").over(own))
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), F.col("signal") + F.col("boost") + 0.08 * (F.col("i") / F.greatest(F.lit(1), F.col("n") - 1))), 9))
    top = F.row_number().over(own.orderBy(F.desc("score"), "i")) <= F.greatest(F.lit(5), F.floor(F.col("n") * 0.25))
    return rows.select("session_id", "message_index", "score", top.alias("top"))


def bucketed(chunks: DataFrame, most: int = 8, borrowed: int = 3) -> DataFrame:
    """(session_id, section, place, chunk_id) of chunks (session_id, chunk_id, kind, text, score): the best decisions, code and,
    of all that is left, context, `most` each. Without a decision the best of the context, if over two, stand in for them.
    Equal scores go by chunk_id. A chunk's rank in its own class is cut first, so that a hot session sends few rows."""
    kind = F.when((F.col("kind") == "message") & F.col("text").rlike(BUCKET_DECISIONS), "decisions").when(F.col("kind") == "code", "code").otherwise("context")
    best = (F.desc("score"), F.asc("chunk_id"))
    rows = chunks.select("session_id", "chunk_id", "score", kind.alias("section"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("session_id", "section").orderBy(*best))).filter(F.col("place") <= 2 * most)
    rows = rows.withColumn("section", F.when(F.col("place") > most, "context").otherwise(F.col("section")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("session_id", "section").orderBy(*best))).filter(F.col("place") <= most)
    own = Window.partitionBy("session_id")
    count = lambda section: F.count_if(F.col("section") == section).over(own)
    lends = (count("decisions") == 0) & (count("context") > 2)
    rows = rows.withColumn("lends", lends & (F.col("section") == "context"))
    moved = F.col("lends") & (F.col("place") <= borrowed)
    place = F.when(F.col("lends") & ~moved, F.col("place") - borrowed).otherwise(F.col("place"))
    return rows.select("session_id", F.when(moved, "decisions").otherwise(F.col("section")).alias("section"), place.cast("long").alias("place"), "chunk_id")


def content_roles(messages: DataFrame) -> DataFrame:
    """(session_id, message_index, inferred): roles by what texts of ten characters or more look like: code, headings, bold
    words, lists and lengths over 200 are an assistant's."""
    c = stripped(F.col("content"))
    looks = c.contains("```") | c.rlike(r"^#{1,3}\s|\*\*[^*]|\n- ") | (F.length(c) > 200)
    return _messages(messages).filter(F.length(c) >= 10).select("session_id", "message_index", F.when(looks, "assistant").otherwise("user").alias("inferred"))


def recommendations(records: DataFrame) -> DataFrame:
    """(kind, platform, value): what records (platform, score, code, retention, compression) of scored outputs call for: mean
    retention under 12 of 15, platforms of two records or more with a mean score under 75, three records or more with code
    under 18 of 20, mean compression under 7 of 10."""
    some = records.groupBy("platform").agg(*(f(c).alias(f"{n}_{c}") for c in ("retention", "compression", "score") for n, f in (("sum", F.sum), ("n", F.count))), F.count_if(F.col("code") < 18).alias("weak"))
    low = some.filter("n_score >= 2 AND sum_score / n_score < 75").select(F.lit("platform").alias("kind"), "platform", F.expr("sum_score / n_score").cast("double").alias("value"))
    total = some.agg(*(F.sum(c).alias(c) for c in some.columns if c != "platform"))
    kinds = [("retention", "sum_retention / n_retention", "< 12"), ("code", "weak", ">= 3"), ("compression", "sum_compression / n_compression", "< 7")]
    found = F.array(*(F.when(F.expr(f"{value} {limit}"), F.struct(F.lit(kind).alias("kind"), F.expr(value).cast("double").alias("value"))) for kind, value, limit in kinds))
    overall = total.select(F.explode(F.array_compact(found)).alias("x")).select("x.kind", F.lit(None).cast("string").alias("platform"), "x.value")
    return overall.unionByName(low).withColumn("value", F.round("value", 6))
