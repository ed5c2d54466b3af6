"""Contexts and summaries of sessions, as rows of sections: (session_id, section, place, text ..).

What a session's messages hold for a section is told in one projection, without a shuffle of texts. The items found are
de-duplicated by session, section and text, the first one staying, and ranked within their session and section; a rank with
a limit is cut in each task first, so that a session with a third of all messages sends few rows to one task. What depends
on a message's place from the end takes part as (session, place) rows without texts.

Null contents are empty; a session without messages has no rows; roles other than 'user' and 'assistant' count as messages
but give no items that ask for a role.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.functions import text as T
from threadlake.functions.keeping import once
from threadlake.functions.text import stripped

# FIXED values: patterns by section, limits, and messages that are no goals. Those of one list are alternatives.
COMPLETED = [r"(?im:^(?:here(?:'s| is)|i(?:'ve| have)|done|created|updated|fixed|added|implemented|built)[:\s])", r"(?i:\bis now\b|\bworks now\b|\bsuccessfully\b|\bcompleted?\b)"]
PENDING = [r"(?i:\btodo\b|next step|you(?:'ll| will) need|remaining|left to do|still need)", r"(?i:\bone more thing\b|should also|we need to|i(?:'ll| will) need)", r"(?i:\bnot yet\b|\bpending\b)"]
DECISIONS = [
    r"(?i:instead of|rather than|chose|chosen|decided|opted for|went with)", r"(?i:\bgoing with\b)", r"(?i:\blet['’]s use\b)", r"(?i:\bsticking with\b)", r"(?i:\bswitching to\b)", r"(?i:\binstead I['’]ll\b)", r"(?i:\bmigrating to\b)",
    r"(?i:\bbest approach\b)", r"(?i:\bthe approach is\b)", r"(?i:\bwe use\b)", r"(?i:the reason|because.*approach|trade-?off)", r"(?i:\bthis works because\b)", r"(?i:\bbecause of\b)", r"(?i:(?:will|'ll) use .{3,30} (?:instead|for this|here))", r"(?i:\bwe('?ll| will) use\b)",
]
META = [r"(?i:Transformers\s+are\s+overkill|looking\s+for\s+['\"‘“]|pattern\s+matched|keep\s+verbatim|overkill\s+when\s+you|detection\s+pattern|internal\s+regex|you['’]re\s+looking\s+for|scan\s+(the\s+)?first\s+\d)"]
FACTS = [r"(?i:\b(?:must|cannot|can't|requires|depends on|note that|important:|warning:))", r"(?i:\b(?:version|api key|endpoint|port|url|config)\b)"]
MADE_DECISIONS = [
    r"(?i:\bwe decided\b)", r"(?i:\bi('?ve| have) decided\b)", r"(?i:\bdecided to\b)", r"(?i:\bthe fix is\b)", r"(?i:\bthe fix was\b)", r"(?i:\bgoing with\b)", r"(?i:\bwent with\b)", r"(?i:\bopted for\b)", r"(?i:\bchose to\b)", r"(?i:\bwe chose\b)",
    r"(?i:\bi chose\b)", r"(?i:\bswitched to\b)", r"(?i:\bswitching to\b)", r"(?i:\breplaced.*?with\b)", r"(?i:\blet['’]s use\b)", r"(?i:\bwe['’]re using\b)", r"(?i:\bwe will use\b)", r"(?i:\bwe use\b)", r"(?i:\bi['’]ll use\b)",
    r"(?i:\bthe approach is\b)", r"(?i:\bbest approach is\b)", r"(?i:\bthis works because\b)", r"(?i:\bmigrating to\b)", r"(?i:\bsticking with\b)", r"(?i:\bmoved (?:the|it|this|everything) to\b)", r"(?i:\bi['’]d (?:recommend|suggest|build|use)\b)",
    r"(?i:\byou should\b)", r"(?i:\bthe (?:right|correct|best|recommended|durable|stronger) (?:approach|strategy|solution|fix|architecture|pattern|way)\b)", r"(?i:\bfix (?:that|this|it) first\b)", r"(?i:\binstead of\b.*\buse\b)", r"(?i:\brather than\b)",
    r"(?i:\bthe key (?:insight|change|difference|improvement) is\b)", r"(?i:\bthis (?:is|was) (?:the|a) (?:correct|right|better|proper|durable)\b)", r"(?i:\bthe (?:real|actual|core|underlying) (?:issue|problem|cause) (?:is|was)\b)",
    r"(?i:\bpractical plan\b)", r"(?i:\bimmediate action\b)", r"(?i:\bphase \d\b.*?:)",
]
BUGS = [
    r"(?i:\bthe (?:root )?cause (?:was|is)\b)", r"(?i:\bbug was caused by\b)", r"(?i:\berror occurs because\b)", r"(?i:\bcaused by (?:the|a|an)\b)", r"(?i:\bturned out (?:to be|that) (?:the|a|an)\b)",
    r"(?i:\bthe (?:real )?(?:bug|issue|error|problem) (?:was|is) (?:that|in|because|caused)\b)", r"(?i:\bbecause of (?:the|a|an) (?:missing|stale|bad|wrong|incorrect|broken)\b)", r"(?i:\bfixed (?:it|this|the bug|the issue|the error) by\b)",
    r"(?i:\bresolved by\b)", r"(?i:\bthe fix (?:was|is)\b)", r"\bthrows? (?:a |an )?[A-Z]\w+(?:Error|Exception)\b", r"(?i:\b(?:race condition|deadlock|null pointer|memory leak|off[- ]by[- ]one|infinite loop)\b)", r"(?i:\bregression\b)",
    r"(?i:\b(?:is|was|keeps?) break(?:ing|s)\b)", r"(?i:\b(?:is|was) fail(?:ing|ed)\b)", r"(?i:\bfails? to (?:parse|extract|detect|capture|load|render|inject|match)\b)", r"(?i:\bnot (?:matching|detecting|capturing|parsing|loading|rendering)\b)",
    r"(?i:\breturning? (?:0|null|undefined|empty|nothing|no (?:results?|data|messages?))\b)", r"(?i:\blogs? show\b)", r"\bHTTP [45]\d\d\b", r"(?i:\b(?:selector|element|container) (?:not found|missing|changed|broken)\b)",
    r"(?i:\bfailed to (?:fetch|load|parse|connect|index)\b)", r"(?i:\b(?:wasn['’]t|isn['’]t|doesn['’]t) (?:work|render|load|fire|trigger|update|fetch|save|persist)(?:ing|ed)?\b)",
]
KEY_DECISIONS = [
    r"(?i:\bwe decided\b)", r"(?i:\bdecided to\b)", r"(?i:\bgoing with\b)", r"(?i:\bopted for\b)", r"(?i:\bwe('?ll| will) use\b)", r"(?i:\bchose to\b)", r"(?i:\bwe chose\b)", r"(?i:\bswitching to\b)", r"(?i:\bmigrating to\b)", r"(?i:\bbest approach\b)",
    r"(?i:\bthe approach is\b)", r"(?i:\bwe use\b)", r"(?i:\busing\b)", r"(?i:\bwent with\b)", r"(?i:\bshould use\b)", r"(?i:\bmust use\b)", r"(?i:\bthe fix is\b)", r"(?i:\bthe fix\b)", r"(?i:\bfixed by\b)", r"(?i:\b(?:root |the )?cause\b)", r"(?i:\broot cause\b)",
    r"(?i:\bbug was\b)", r"(?i:\berror occurs\b)", r"(?i:\bissue was\b)", r"(?i:\bthe problem\b)", r"(?i:\bthe issue\b)", r"(?i:\bresolved by\b)", r"(?i:\bfound it\b)", r"(?i:\bthe goal\b)", r"(?i:\bour goal\b)", r"(?i:\bwe want to\b)", r"(?i:\bwe need to\b)",
    r"(?i:\bwe('?re| are) building\b)", r"(?i:\bthe plan\b)", r"(?i:\bnext step\b)", r"(?i:\bthis works because\b)", r"(?i:\bthe reason\b)", r"(?i:\bbecause of\b)", r"(?i:\bturns out\b)", r"(?i:\brealized that\b)", r"(?i:\barchitecture\b)",
    r"(?i:\buse\s+\S+)", r"(?i:\bi['’]?ve? updated\b)", r"(?i:\bhere['’]?s the\b)", r"(?i:\bthe solution\b)", r"(?i:\bchanged.*\bto\b)", r"(?i:\binstead of\b)", r"(?i:\bneeds? to\b)",
]
DANGLING = [r"(?i:\bthat (?:error|bug|issue|fix|problem)\b)", r"(?i:\bthe (?:same|previous|above|earlier) (?:error|bug|issue|approach|fix|solution)\b)", r"(?i:\bas (?:mentioned|discussed|noted) (?:above|before|earlier)\b)", r"(?i:\bsame (?:issue|problem|error|bug) as\b)", r"(?i:\bthis (?:same|exact) (?:error|bug|issue)\b)"]
MIGRATION = r"(?i:^<context_migration>|<instruction>\s*I am continuing a conversation from)"
TRIVIAL = r"^(?i:ok|hi|hello|hey|say\s+(?:ok|hi|hello)|understand|read\s+(?:this|it|the)|look\s+at|check\s+(?:this|it)|continue|go\s+ahead)\b"
TECHNICAL = r"(?i)\b(?:fix|bug|error|build|deploy|implement|create|add|update|refactor|migrate|test|debug|api|function|component|route|endpoint|database|schema)\b"
FENCED = r"(?s)```([\w-]*)[ \t]*\n(.*?)```"
SYNTAX = r"[{}()\[\];=<>]|\bfunction\b|\bconst\b|\blet\b|\bvar\b|\bdef\b|\bclass\b"
MORE_SYNTAX = SYNTAX + r"|\bimport\b|\bexport\b|\breturn\b|\bif\b\s*\("
PATHS = [r"^(?://|#|--)\s+([\w./\\-]+\.\w+)\s*$", r"^/\*\*?\s*([\w./\\-]+\.\w+)\s*\*/"]
LANGUAGE_NAMES = {"typescript": "TypeScript", "tsx": "TypeScript", "ts": "TypeScript", "javascript": "JavaScript", "jsx": "JavaScript", "js": "JavaScript", "python": "Python", "py": "Python", "rust": "Rust", "go": "Go", "css": "CSS", "scss": "CSS"}
TECHNOLOGIES = [
    (r"\breact\b", "React"), (r"\bnext[/\s]|next\.config", "Next.js"), (r"\bvite\b", "Vite"), (r"\bvue\b", "Vue"), (r"\bsvelte\b", "Svelte"), (r"\bangular\b", "Angular"), (r"\bexpress\b", "Express"), (r"\bfastapi\b|\bflask\b|\bdjango\b", "Python Web"),
    (r"\bprisma\b", "Prisma"), (r"\bsupabase\b", "Supabase"), (r"\bdrizzle\b", "Drizzle"), (r"\btailwind\b", "TailwindCSS"), (r"\btrpc\b", "tRPC"), (r"\bgraphql\b", "GraphQL"), (r"\bwebpack\b", "Webpack"), (r"\bdocker\b", "Docker"), (r"\bkubernetes\b|\bk8s\b", "Kubernetes"),
    (r"\bpostgres\b|\bpg\b", "PostgreSQL"), (r"\bmongodb\b|\bmongoose\b", "MongoDB"), (r"\bredis\b", "Redis"), (r"\btypescript\b|\.tsx?\b", "TypeScript"), (r"\bpython\b|import numpy|import pandas", "Python"), (r"\brust\b|\bcargo\b", "Rust"), (r"\bgolang\b|\bgo\b", "Go"),
]
CONTEXT_CAPS = {"completed": 12, "pending": 10, "decisions": 8, "facts": 8, "code": 30, "focus": 3}
SUMMARY_CAPS = {"decisions": 20, "bugs": 15, "completed": 12, "pending": 10, "code": 15, "tech": 12}
NOT_SPECIFIED, LONG_OUTPUT, TRANSCRIPT_HEAD, TRANSCRIPT_TAIL = "Not specified", 48_000, 5, 10
#: Of message scores: least score, how many at most, how many at least.
CATEGORIES = {"goals": (0.25, 6, 2), "decisions": (0.30, 10, 3), "bugs": (0.32, 12, 3), "context": (0.28, 8, 2), "questions": (0.30, 5, 1)}
#: Items of a section that a trim leaves, in the order in which sections are trimmed.
FLOORS = {"decisions": 3, "bugs": 3, "pending": 1, "completed": 2}
TOKEN_BUDGET = 3800

_MARK = "\x01"
_ITEM = "array<struct<section:string,pos:int,score:double,text:string>>"


def matches(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def sentences(content: Column) -> Column:
    """Cut after full stops followed by white space and at line breaks, trimmed."""
    return F.transform(F.split(content, r"(?<=[.!?])\s+|\n+"), stripped)


def clauses(content: Column) -> Column:
    """Cut at every full stop and line break, trimmed."""
    return F.transform(F.split(content, r"[.!?\n]"), stripped)


def _picked(section: str, units: Column, on: Column, keep, score=lambda s: F.lit(0.0), prefix: str = "") -> Column:
    """The units that keep holds for, with their places, as items of a section."""
    placed = F.transform(units, lambda s, i: F.struct(F.lit(section).alias("section"), i.alias("pos"), score(s).cast("double").alias("score"), (F.concat(F.lit(prefix), s) if prefix else s).alias("text"), s.alias("bare")))
    found = F.transform(F.filter(placed, lambda x: keep(x["bare"])), lambda x: F.struct(x["section"].alias("section"), x["pos"].alias("pos"), x["score"].alias("score"), x["text"].alias("text")))
    return F.when(on, found).otherwise(F.array().cast(_ITEM))


def _completed(content: Column, assistant: Column) -> Column:
    first = stripped(F.element_at(F.split(stripped(F.element_at(F.split(content, "\n"), 1)), "[.!?]"), 1))
    return _picked("completed", F.array(first), assistant & matches(content, COMPLETED), lambda s: (F.length(s) > 10) & (F.length(s) < 200))


def _pending(content: Column) -> Column:
    return _picked("pending", clauses(content), F.lit(True), lambda s: (F.length(s) > 15) & matches(s, PENDING))


def _exploded(messages: DataFrame, *items: Column) -> DataFrame:
    rows = messages.select("session_id", "message_index", F.explode(F.concat(*items)).alias("x"))
    return rows.select("session_id", "x.section", F.col("message_index").alias("at"), "x.pos", "x.score", "x.text")


def code_blocks(messages: DataFrame) -> DataFrame:
    """(session_id, message_index, pos, language, path, context, code): fenced blocks; those without a language only if
    they look like code. context is the last clause of the 200 characters before, if it has over ten."""
    rows = messages.select("session_id", "message_index", F.regexp_replace("content", _MARK, "").alias("content"))
    rows = rows.withColumn("fences", F.regexp_extract_all("content", F.lit(r"(?s)(```[\w-]*[ \t]*\n.*?```)"), 1)).withColumn("prose", F.split(F.regexp_replace("content", FENCED, _MARK), _MARK))
    rows = rows.select("session_id", "message_index", "content", "fences", "prose", F.posexplode("fences").alias("pos", "fence"))
    rows = rows.withColumn("language", F.regexp_extract("fence", FENCED, 1)).withColumn("code", F.regexp_extract("fence", FENCED, 2))
    n_lines = F.size(F.filter(F.split("code", "\n"), lambda x: stripped(x) != ""))
    rows = rows.filter((F.col("language") != "") | ((n_lines >= 2) & F.col("code").rlike(SYNTAX)))
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    start = length(F.slice("prose", 1, F.col("pos") + 1)) + length(F.slice("fences", 1, F.col("pos")))
    before = F.substring("content", F.greatest(F.lit(1), start - 199), F.least(start, F.lit(200)))
    context = F.try_element_at(F.filter(clauses(before), lambda x: F.length(x) > 10), F.lit(-1))
    first = stripped(F.element_at(F.split("code", "\n"), 1))
    path = F.coalesce(*(F.nullif(F.regexp_extract(first, p, 1), F.lit("")) for p in PATHS))
    language = F.when(F.col("language") == "", "text").otherwise(F.col("language"))
    return rows.select("session_id", "message_index", "pos", language.alias("language"), path.alias("path"), context.alias("context"), "code")


def _capped(items: DataFrame, caps: dict[str, int], *order: str) -> DataFrame:
    """items (session_id, section, text, ..) once for each text, the first by order, with their places up to the caps."""
    rest = [c for c in items.columns if c not in ("session_id", "section", "text", *order)]
    once = items.groupBy("session_id", "section", "text").agg(F.min(F.struct(*order, *rest)).alias("x"))
    place = F.row_number().over(Window.partitionBy("session_id", "section").orderBy(*(f"x.{c}" for c in order)))
    cap = reduce(lambda c, s: c.when(F.col("section") == s, caps[s]), list(caps)[1:], F.when(F.col("section") == next(iter(caps)), next(iter(caps.values()))))
    rows = once.withColumn("place", place).filter(F.col("place") <= max(caps.values())).filter(F.col("place") <= cap)
    return rows.select("session_id", "section", "place", "text", *(F.col(f"x.{c}").alias(c) for c in rest))


def _tails(messages: DataFrame, most: int) -> DataFrame:
    """(session_id, message_index, back): the places of the last messages, 1 for the last one."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("message_index")))
    return messages.select("session_id", "message_index").withColumn("back", back).filter(F.col("back") <= most)


def _late(items: DataFrame, messages: DataFrame, most: int) -> DataFrame:
    """Of pending items those of the last messages, and all others."""
    start = _tails(messages, most).groupBy("session_id").agg(F.min("message_index").alias("_start"))
    return items.join(start, "session_id").filter((F.col("section") != "pending") | (F.col("at") >= F.col("_start"))).drop("_start")


def _one(messages: DataFrame, section: str, value: Column, on: Column, first: bool = True) -> DataFrame:
    """One row a session: the first or last value that `on` holds for, or NOT_SPECIFIED."""
    best = (F.min_by if first else F.max_by)(value, F.when(on, F.col("message_index")))
    found = F.max(F.when(on, True))
    rows = messages.groupBy("session_id").agg(best.alias("text"), found.alias("found"))
    return rows.select("session_id", F.lit(section).alias("section"), F.lit(1).alias("place"), F.when(F.col("found") & (F.col("text") != ""), F.col("text")).otherwise(NOT_SPECIFIED).alias("text"))


def _full(rows: DataFrame) -> DataFrame:
    for c in ("language", "path", "context"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows.select("session_id", "section", F.col("place").cast("bigint").alias("place"), "text", "language", "path", "context")


def contexts(messages: DataFrame) -> DataFrame:
    """(session_id, section, place, text, language, path, context): goal, focus, completed, pending, decisions, facts, code."""
    m = messages.withColumn("content", F.coalesce("content", F.lit("")))
    c, assistant = F.col("content"), F.col("role") == "assistant"
    prompt, units = T.is_prompt(c), clauses(c)
    decided = _picked("decisions", units, assistant & ~prompt, lambda s: (F.length(s) > 20) & matches(s, DECISIONS) & ~matches(s, META), prefix="- ")
    facts = _picked("facts", units, ~prompt, lambda s: (F.length(s) > 20) & matches(s, FACTS), prefix="- ")
    items = _late(_exploded(m, _completed(c, assistant), _pending(c), decided, facts).drop("score"), m, 20)
    found = _capped(items, {s: CONTEXT_CAPS[s] for s in ("completed", "pending", "decisions", "facts")}, "at", "pos")
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("message_index")))
    focus = m.select("session_id", "message_index", ellipsis(stripped(c), 300).alias("text")).filter(F.length("text") >= 20).withColumn("back", back).filter(F.col("back") <= CONTEXT_CAPS["focus"])
    focus = focus.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
    focus = m.select("session_id").distinct().join(focus, "session_id", "left").select("session_id", F.lit("focus").alias("section"), F.lit(1).alias("place"), F.coalesce("text", F.lit(NOT_SPECIFIED)).alias("text"))
    goal = _one(m, "goal", ellipsis(stripped(c), 600), (F.col("role") == "user") & ~stripped(c).rlike(MIGRATION))
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("message_index"), "pos"))
    code = code_blocks(m).withColumn("r", newest).filter(F.col("r") <= CONTEXT_CAPS["code"])
    code = code.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("r")))).withColumn("section", F.lit("code")).withColumnRenamed("code", "text")
    return reduce(DataFrame.unionByName, map(_full, (goal, focus, found, code)))


def _goal(content: Column) -> Column:
    """Whether a request can be a session's goal."""
    t = stripped(content)
    return ~t.rlike(MIGRATION) & ((F.length(t) >= 50) | t.rlike(TECHNICAL)) & ~(t.rlike(TRIVIAL) & (F.length(t) < 80))


def _state(m: DataFrame) -> DataFrame:
    """The last fit one of the requests at the start, the quarters and the end, or else the last request."""
    own = Window.partitionBy("session_id")
    u = m.filter("role = 'user'").select("session_id", "message_index", F.length("content").alias("n_chars"), F.substring("content", 1, 400).alias("text"))
    u = u.withColumn("i", F.row_number().over(own.orderBy("message_index")) - 1).withColumn("n", F.count("*").over(own))
    places = [F.lit(0), *(F.floor(F.col("n") * q) for q in (0.25, 0.5, 0.75)), F.col("n") - 1]
    fit = reduce(lambda a, b: a | b, [F.col("i") == p for p in places]) & (F.col("n_chars") > 30) & (F.col("n_chars") < 800) & ~F.col("text").startswith("You are a") & ~F.col("text").startswith("Read every file")
    best = u.groupBy("session_id").agg(F.coalesce(F.max_by("text", F.when(fit, F.col("i"))), F.max_by("text", "i")).alias("text"), F.max(F.when(fit, 1)).alias("fit"), F.max_by("text", "i").alias("last"))
    best = best.select("session_id", F.when(F.col("fit") == 1, F.col("text")).otherwise(F.col("last")).alias("text"))
    rows = m.select("session_id").distinct().join(best, "session_id", "left")
    return rows.select("session_id", F.lit("state").alias("section"), F.lit(1).alias("place"), F.coalesce(F.nullif("text", F.lit("")), F.lit(NOT_SPECIFIED)).alias("text"))


def _sentence_items(m: DataFrame, longest: int | None = 400) -> DataFrame:
    """Decisions and bugs that the assistant tells of, with their scores."""
    c = F.col("content")
    on = (F.col("role") == "assistant") & ~T.is_prompt(c) & ~T.is_meta_discussion(c)
    fits = lambda s: (F.length(s) > 20) & (F.length(s) < longest if longest else F.lit(True))
    score = lambda scores: lambda s: F.round(T.weighed(s, scores), 6)
    decided = _picked("decisions", sentences(c), on, lambda s: fits(s) & matches(s, MADE_DECISIONS) & ~matches(s, META), score(T.DECISION_SCORES))
    bugs = _picked("bugs", sentences(c), on, lambda s: fits(s) & matches(s, BUGS), score(T.BUG_SCORES))
    return _exploded(m, decided, bugs).withColumn("score", -F.col("score"))


def _summary_code(m: DataFrame) -> DataFrame:
    """Blocks with a path first, one for each path or beginning, without plain texts of 200 characters or more."""
    b = code_blocks(m)
    b = b.filter((F.col("language") != "text") | F.col("path").isNotNull() | (F.length("code") < 200) | F.col("code").rlike(MORE_SYNTAX))
    b = b.withColumn("key", F.coalesce("path", F.substring("code", 1, 60))).withColumn("anonymous", F.col("path").isNull())
    once = b.groupBy("session_id", "key").agg(F.min(F.struct("anonymous", "message_index", "pos", "language", "path", "code")).alias("x")).select("session_id", "x.*")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("anonymous", "message_index", "pos"))
    return once.withColumn("place", place).filter(F.col("place") <= SUMMARY_CAPS["code"]).withColumn("section", F.lit("code")).withColumnRenamed("code", "text")


def _technologies(m: DataFrame) -> DataFrame:
    fences = m.select("session_id", F.col("message_index").alias("at"), F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)(```[\w-]*[ \t]*\n.*?```)"), 1)).alias("pos", "fence"))
    language, body = F.lower(F.regexp_extract("fence", FENCED, 1)), F.regexp_extract("fence", FENCED, 2)
    named = F.coalesce(*(F.when(language == k, F.lit(v)) for k, v in LANGUAGE_NAMES.items()))
    found = F.array_compact(F.array(named, *(F.when(body.rlike(f"(?i){p}"), F.lit(v)) for p, v in TECHNOLOGIES)))
    rows = fences.select("session_id", F.lit("tech").alias("section"), "at", "pos", F.posexplode(found).alias("nth", "text"))
    return _capped(rows, {"tech": SUMMARY_CAPS["tech"]}, "at", "pos", "nth")


def _summary_tail(m: DataFrame) -> DataFrame:
    """All of 30 messages, the last 12 of 80, or the last 6; and two before each that speaks of something earlier."""
    own = Window.partitionBy("session_id").orderBy("back")
    asks = matches(F.col("content"), DANGLING)
    n = m.groupBy("session_id").agg(F.count("*").alias("n"))
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("message_index")))
    t = m.select("session_id", "message_index", asks.alias("asks")).withColumn("back", back).filter(F.col("back") <= 32).join(n, "session_id")
    t = t.withColumn("tail", F.col("back") <= F.when(F.col("n") <= 30, 30).when(F.col("n") <= 80, 12).otherwise(6)).withColumn("asks", F.col("asks") & F.col("tail"))
    t = t.withColumn("wanted", F.coalesce(F.lag("asks", 1).over(own), F.lit(False)) | F.coalesce(F.lag("asks", 2).over(own), F.lit(False))).filter("tail OR wanted")
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("message_index"))).select("session_id", "message_index", "place")
    return m.join(t, ["session_id", "message_index"]).select("session_id", F.lit("tail").alias("section"), "place", F.col("content").alias("text"), F.col("role").alias("context"))


def summaries(messages: DataFrame, task: str | None = None) -> DataFrame:
    """(session_id, section, place, text, language, path, context): goal, state, decisions, bugs, completed, pending, code, tech
    and tail, whose context is the role; and ratio, the percentage saved.

    With a task, decisions without any of its words of over three letters go, unless all would, and code with one comes first."""
    m = messages.withColumn("content", F.coalesce("content", F.lit("")))
    c, assistant = F.col("content"), F.col("role") == "assistant"
    told = _capped(_sentence_items(m), {s: SUMMARY_CAPS[s] for s in ("decisions", "bugs")}, "score", "at", "pos")
    items = _late(_exploded(m, _completed(c, assistant), _pending(c)).drop("score"), m, 40)
    done = _capped(items, {s: SUMMARY_CAPS[s] for s in ("completed", "pending")}, "at", "pos")
    code = _summary_code(m)
    words = [w for w in (task or "").lower().split() if len(w) > 3]
    if words:
        hit = lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(w) for w in words])
        told = told.withColumn("_hit", hit(F.col("text"))).withColumn("_any", F.max("_hit").over(Window.partitionBy("session_id", "section")))
        told = told.filter("section <> 'decisions' OR _hit OR NOT _any").withColumn("place", F.row_number().over(Window.partitionBy("session_id", "section").orderBy("place"))).drop("_hit", "_any")
        near = hit(F.col("text")) | hit(F.coalesce("path", F.lit("")))
        code = code.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(near), "place")))
    user = F.col("role") == "user"
    goal = _one(m, "goal", F.substring(stripped(c), 1, 600), user & _goal(c))
    parts = once(reduce(DataFrame.unionByName, map(_full, (goal, _state(m), told, done, code, _technologies(m), _summary_tail(m)))))
    # A union, as in a join of what comes from the same messages the planner no longer knows the parts that are kept.
    sizes = m.select("session_id", F.length("content").alias("whole"), F.lit(0).alias("kept")).unionByName(parts.filter("section <> 'tech'").select("session_id", F.lit(0).alias("whole"), F.length("text").alias("kept")))
    whole = sizes.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.sum("whole").alias("whole"), F.sum("kept").alias("kept"))
    saved = F.when(F.col("whole") > 0, F.greatest(F.lit(0), F.floor((1 - F.col("kept") / F.col("whole")) * 100 + 0.5))).otherwise(0).cast("bigint").cast("string")
    return parts.unionByName(_full(whole.select("session_id", F.lit("ratio").alias("section"), F.lit(1).alias("place"), saved.alias("text"))))


# -- whole transcripts


def in_sentences(content: Column, most: int) -> Column:
    """The first sentences, and all fenced code: what is not within them follows. Error reports stay whole.

    A fence is one mark while sentences are cut, so that marks in what is kept are the first ones in turn."""
    fence = r"(?s)```.*?```"
    blocks = F.regexp_extract_all(content, F.lit(f"({fence})"), 1)
    cut = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(content, _MARK, ""), fence, _MARK), r"(?<=[.!?])\s+|\n{2,}"), stripped), lambda s: s != "")
    kept = F.split(F.array_join(F.slice(cut, 1, most), " "), _MARK)
    n = F.size(kept) - 1
    inside = F.array_join(F.transform(kept, lambda s, i: F.concat(s, F.when(i < n, F.get(blocks, i)).otherwise(""))), "")
    rest = F.array_join(F.slice(blocks, n + 1, F.greatest(F.lit(0), F.size(blocks) - n)), "\n\n")
    short = stripped(F.when(rest != "", F.concat(inside, F.lit("\n\n"), rest)).otherwise(inside))
    return F.when(T.has_error(content), content).when(short != "", short).otherwise(F.substring(content, 1, 200))


def key_decision(prose: Column) -> Column:
    """The first sentence of over ten characters that tells of a decision, 200 characters at most; null without one."""
    cut = F.filter(F.transform(F.split(stripped(prose), r"(?<=[.!?])\s+|\n{2,}"), stripped), lambda s: F.length(s) > 10)
    found = F.substring(F.try_element_at(F.filter(cut, lambda s: matches(s, KEY_DECISIONS)), F.lit(1)), 1, 200)
    return F.when((F.length(stripped(prose)) >= 5) & ~T.is_acknowledgement(prose), found)


def message_scores(messages: DataFrame) -> DataFrame:
    """(session_id, message_index, role, content, i, n, score): of messages between a session's first 5 and last 10 the
    weight of errors, code, decisions, length and lateness; null for the others."""
    own = Window.partitionBy("session_id")
    m = messages.select("session_id", "message_index", "role", F.coalesce("content", F.lit("")).alias("content"))
    m = m.withColumn("i", F.row_number().over(own.orderBy("message_index")) - 1).withColumn("n", F.count("*").over(own))
    c, middle = F.col("content"), F.col("n") - TRANSCRIPT_HEAD - TRANSCRIPT_TAIL
    signal = F.when(T.has_error(c), 0.45).otherwise(0.0) + F.when(c.rlike(r"(?s)```.*?```"), 0.25).otherwise(0.0) + F.when(matches(c, KEY_DECISIONS), 0.20).otherwise(0.0)
    score = F.least(F.lit(1.0), signal + F.least(F.lit(0.10), F.length(c) / 8000.0) + 0.05 * ((F.col("i") - TRANSCRIPT_HEAD) / F.greatest(F.lit(1), middle - 1)))
    inside = (F.col("i") >= TRANSCRIPT_HEAD) & (F.col("i") < F.col("n") - TRANSCRIPT_TAIL)
    return m.withColumn("score", F.when(inside, F.round(score, 9)))


def transcripts(messages: DataFrame) -> DataFrame:
    """(session_id, message_index, role, content, n): what is left of each message. Under 30 messages all stay; up to 100 the
    middle's assistant messages are cut to two sentences; beyond, those of the best quarter stay and the others are cut to a
    decision and their code, or go."""
    m = message_scores(messages)
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score")))
    cut = m.filter("score IS NOT NULL AND n > 100").select("session_id", "n", "score").withColumn("r", rank)
    cut = cut.filter(F.col("r") == F.greatest(F.lit(0), F.floor((F.col("n") - TRANSCRIPT_HEAD - TRANSCRIPT_TAIL) * 0.25) - 1) + 1).select("session_id", F.col("score").alias("cutoff"))
    m = m.join(cut, "session_id", "left")
    c = F.col("content")
    code = F.array_join(F.regexp_extract_all(c, F.lit(r"(?s)(```.*?```)"), 1), "\n\n")
    said = key_decision(F.regexp_replace(c, r"(?s)```.*?```", ""))
    short = F.nullif(F.concat_ws("\n\n", said, F.nullif(code, F.lit(""))), F.lit(""))
    whole = F.col("score").isNull() | (F.col("role") == "user") | (F.col("n") < 30)
    high = T.has_error(c) | ((F.col("score") >= F.col("cutoff")) & (F.col("score") >= 0.30))
    left = F.when(whole, c).when(F.col("n") <= 100, in_sentences(c, 2)).when(high, c).otherwise(short)
    return m.withColumn("content", left).filter("content IS NOT NULL").select("session_id", "message_index", "role", "content", "n")


def transcript_blocks(kept: DataFrame, most: int | None = LONG_OUTPUT) -> DataFrame:
    """(session_id, message_index, block, text): transcripts cut at empty lines. Of one with more than `most` characters and
    30 messages the oldest blocks go, but not the first 5 and the last 10."""
    line = F.concat(F.upper("role"), F.lit(": "), F.col("content"))
    rows = kept.select("session_id", "message_index", "n", F.posexplode(F.split(line, "\n\n")).alias("block", "text"))
    if most is None:
        return rows.drop("n")
    # Only lengths are ranked; texts wait.
    own = Window.partitionBy("session_id")
    size = rows.select("session_id", "message_index", "block", "n", F.length("text").alias("size"))
    size = size.withColumn("place", F.row_number().over(own.orderBy("message_index", "block")) - 1).withColumn("k", F.count("*").over(own))
    edge = (F.col("place") < TRANSCRIPT_HEAD) | (F.col("place") >= F.col("k") - TRANSCRIPT_TAIL)
    edges = F.sum(F.when(F.col("edge"), F.col("size") + 2).otherwise(0)).over(own)
    later = F.sum(F.when(F.col("edge"), 0).otherwise(F.col("size") + 2)).over(own.orderBy(F.desc("place")))
    size = size.withColumn("edge", edge).withColumn("whole", edges + later - 2).filter(F.col("edge") | (F.col("n") < 30) | (F.col("whole") <= most))
    return rows.drop("n").join(size.select("session_id", "message_index", "block"), ["session_id", "message_index", "block"])


# -- summaries with scores of messages


def selected(scored: DataFrame, category: str) -> DataFrame:
    """The messages of scored (session_id, message_index, .., scores map, boost) that stand for a category: the best by score and
    boost of those with the least score; or, if they are too few, the best by score alone."""
    least, most, floor = CATEGORIES[category]
    own = Window.partitionBy("session_id")
    rows = scored.withColumn("_score", F.col("scores")[category]).withColumn("_good", F.col("_score") >= least)
    n_good = rows.groupBy("session_id").agg(F.count_if("_good").alias("_n_good"))
    best = F.row_number().over(own.orderBy(F.desc("_score"), "message_index"))
    weighed = F.row_number().over(Window.partitionBy("session_id", "_good").orderBy(F.desc(F.round(F.col("_score") * F.col("boost"), 9)), "message_index"))
    rows = rows.withColumn("_best", best).withColumn("_weighed", weighed).filter((F.col("_best") <= floor) | (F.col("_good") & (F.col("_weighed") <= most)))
    rows = rows.join(n_good, "session_id").filter(F.when(F.col("_n_good") < floor, F.col("_best") <= floor).otherwise(F.col("_good") & (F.col("_weighed") <= most)))
    return rows.select(*scored.columns)


def trimmed(items: DataFrame, fixed: DataFrame, budget: int = TOKEN_BUDGET) -> DataFrame:
    """items (session_id, section, place, text) without those that a budget of tokens has no room for; fixed (session_id, tokens)
    is what else counts. Sections give up their last items in the order of FLOORS, down to their floor, until what is over
    is gone: an item goes if those that went before it were not enough, so a running sum tells."""
    tokens = T.token_estimate(F.col("text"))
    order = {s: i for i, s in enumerate(FLOORS)}
    rank, floor = (F.coalesce(*(F.when(F.col("section") == s, v) for s, v in values.items())) for values in (order, FLOORS))
    total = items.groupBy("session_id").agg(F.sum(tokens).alias("_sum"))
    rows = items.withColumn("_tokens", tokens).withColumn("_may", F.col("place") > floor).join(total, "session_id").join(fixed, "session_id", "left")
    over = F.col("_sum") + F.coalesce("tokens", F.lit(0)) - budget
    before = Window.partitionBy("session_id").orderBy(rank, F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(F.col("_may"), F.col("_tokens")).otherwise(0)).over(before), F.lit(0))
    return rows.withColumn("_gone", gone).filter(~(F.col("_may") & (F.col("_gone") < over))).select("session_id", "section", "place", "text")


def scored_summaries(messages: DataFrame, scored: DataFrame, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(session_id, section, place, text): summaries whose goal, decisions and bugs also come from the messages that scored
    (session_id, message_index, scores, boost) puts first, within a budget of tokens."""
    base = summaries(messages)
    m = messages.withColumn("content", F.coalesce("content", F.lit(""))).join(once(scored), ["session_id", "message_index"])
    lists = F.col("section").isin(list(FLOORS))
    first = {}
    for section in ("decisions", "bugs"):
        found = _sentence_items(selected(m, section).select("session_id", "message_index", "role", "content"), None).filter(F.col("section") == section)
        first[section] = found.select("session_id", "section", "text", F.lit(0).alias("source"), F.col("score").alias("a"), F.col("at").alias("b"), F.col("pos").alias("c"))
    known = base.filter(lists).select("session_id", "section", "text", F.lit(1).alias("source"), F.lit(0.0).alias("a"), F.col("place").alias("b"), F.lit(0).alias("c"))
    items = _capped(reduce(DataFrame.unionByName, [*first.values(), known]), {s: SUMMARY_CAPS[s] for s in FLOORS}, "source", "a", "b", "c")

    def joined(category: str, value: Column, on: Column, mark: str) -> DataFrame:
        rows = selected(m, category).select("session_id", "message_index", value.alias("text"), on.alias("on")).filter("on")
        return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "text"))), lambda x: x["text"]), " | ").alias(mark))

    bare = stripped(F.regexp_replace("content", r"(?s)<context_migration>.*?</context_migration>", ""))
    said = F.element_at(F.split(bare, r"[.?!]\s+"), 1)
    goals = joined("goals", stripped(said), (F.length(bare) >= 15) & (F.length(said) >= 10) & (F.length(said) <= 600), "goals")
    context = joined("context", F.substring("content", 1, 300), F.lit(True), "told")
    asked = joined("questions", F.substring("content", 1, 200), F.lit(True), "asked")
    goal = base.filter("section = 'goal'").select("session_id", "text").join(goals, "session_id", "left").join(context, "session_id", "left").join(asked, "session_id", "left")
    wrapped = lambda c, mark: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{mark}: "), F.col(c), F.lit("]")))
    goal = goal.select("session_id", F.lit("goal").alias("section"), F.lit(1).cast("bigint").alias("place"), F.concat_ws("\n", F.coalesce("goals", "text"), wrapped("told", "Context"), wrapped("asked", "Open")).alias("text"))
    other = base.filter(F.col("section").isin("code", "tail")).select("session_id", "text").unionByName(goal.select("session_id", "text"))
    fixed = other.groupBy("session_id").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))
    return goal.unionByName(trimmed(items.select("session_id", "section", F.col("place").cast("bigint").alias("place"), "text"), fixed, budget))
