"""Exports of whole sessions as one text each: Markdown, plain text, JSON and CSV. A session's messages meet in one row, as its
file is one; sessions (session_id, platform, title, day), messages (session_id, message_index, role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EXPORTER = "threadlake"
TOC_FROM = 10
# FIXED values: languages of indented code, tried in order, and of files by their endings.
INDENTED = [
    (r"^\s*(?:function|const|let|var|import|export|class|interface|type|async|await)\b", "typescript"), (r"^\s*(?:def|class|import|from|print|return|if __name__)", "python"),
    (r"^\s*(?:func|package|import|var)", "go"), (r"^\s*(?:public|private|class|void|int|static)", "java"),
]
ENDINGS = {
    "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "python": "py", "rust": "rs", "go": "go", "java": "java", "csharp": "cs", "cpp": "cpp cc cxx h", "c": "c", "markdown": "md mdx", "json": "json", "yaml": "yaml yml", "sql": "sql",
    "css": "css scss sass less", "html": "html htm", "xml": "xml", "bash": "sh bash", "ruby": "rb", "php": "php", "swift": "swift", "kotlin": "kt", "terraform": "tf hcl",
}
PROBES = [r"(?i)console\.log.*{0}", r"(?i){0}.*DOM PROBE|DOM PROBE.*{0}", r"^\s*\(function\s+\w+\s*\(\s*\)"]


def file_language(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))
    return F.coalesce(*(F.when(ending.isin(e.split()), F.lit(language)) for language, e in ENDINGS.items()), F.lit("plaintext"))


def is_probe(code: Column, marker: str = "DIAGNOSTIC") -> Column:
    """Whether a block is a script that looks at pages: one that logs the marker, calls itself, or walks through elements."""
    walks = (F.length(code) > 500) & code.rlike("querySelectorAll|querySelector") & code.rlike(r"\.forEach\s*\(|for\s*\(")
    found = walks
    for p in PROBES:
        found = found | code.rlike(p.format(marker))
    return (F.length(code) >= 30) & found


def fenced(content: Column) -> Column:
    """Three or more lines in a row that are indented by four, if no others are, as a fence; contents with fences as they are."""
    lines = F.split(content, "\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s{4,}\S"), i)), lambda i: i.isNotNull())
    first, last = F.element_at(at, 1), F.element_at(at, -1)
    right = lambda x: F.regexp_replace(x, r"\s+\z", "")
    code = F.array_join(F.transform(F.slice(lines, first + 1, last - first + 1), lambda x: F.regexp_replace(x, r"^\s{4}", "")), "\n")
    before = F.nullif(right(F.array_join(F.slice(lines, 1, first), "\n")), F.lit(""))
    after = F.nullif(F.regexp_replace(F.array_join(F.slice(lines, last + 2, F.size(lines)), "\n"), r"^\s+", ""), F.lit(""))
    language = F.coalesce(*(F.when(code.rlike(p), F.lit(n)) for p, n in INDENTED), F.lit(""))
    block = F.concat(F.lit("```"), language, F.lit("\n"), code, F.lit("\n```"))
    fits = ~content.contains("```") & (F.size(at) >= 3)
    return F.when(fits, F.when(last - first + 1 == F.size(at), F.concat_ws("\n\n", before, block, after)).otherwise(content)).otherwise(content)


def file_name(platform: Column, title: Column, day: Column, ending: str) -> Column:
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.concat(platform, F.lit("_"), day, F.lit("_"), F.when(slug == "", "session").otherwise(slug), F.lit(f".{ending}"))


def exported(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, name, format, text) in the formats md, txt, json and csv."""
    held = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("message_index", "role", F.coalesce("content", F.lit("")).alias("content")))).alias("m"))
    rows = sessions.join(held, "session_id")
    m, n, title, platform, day = F.col("m"), F.size("m"), F.col("title"), F.col("platform"), F.col("day")
    role = lambda x: F.when(x["role"] == "user", "User").otherwise("Assistant")
    number = lambda i: (i + 1).cast("string")
    front = F.concat(F.lit("---\nplatform: "), platform, F.lit('\ntitle: "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"\ndate: '), day, F.lit("\nsession_id: "), F.col("session_id").cast("string"), F.lit("\nmessage_count: "), n.cast("string"), F.lit(f"\nexported_by: {EXPORTER}\n---\n\n# "), platform, F.lit(" — "), title, F.lit("\n\n> Exported on "), day, F.lit(f" via {EXPORTER}\n\n---\n\n"))
    preview = lambda x: F.trim(F.regexp_replace(F.substring(x["content"], 1, 50), r"[\n\r]+", " "))
    entries = F.array_join(F.transform(m, lambda x, i: F.concat(number(i), F.lit(". [Message "), number(i), F.lit(" — "), role(x), F.lit("](#message-"), number(i), F.lit(") — "), preview(x), F.lit("…"))), "\n")
    contents = F.when(n >= TOC_FROM, F.concat(F.lit("## Table of Contents\n\n"), entries, F.lit("\n\n---\n\n"))).otherwise("")
    body = F.array_join(F.transform(m, lambda x, i: F.concat(F.lit("## Message "), number(i), F.lit("\n\n**Role:** "), role(x), F.lit("\n\n"), fenced(x["content"]), F.lit("\n\n---"))), "\n\n")
    plain = F.concat(platform, F.lit(" | "), title, F.lit(" | "), day, F.lit("\n" + "=" * 60 + "\n\n"), F.array_join(F.transform(m, lambda x: F.concat(F.when(x["role"] == "user", "You:").otherwise("AI:"), F.lit("\n"), x["content"], F.lit("\n"))), "\n"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    csv = F.concat(F.lit("role,content\n"), F.array_join(F.transform(m, lambda x: F.concat(quoted(x["role"]), F.lit(","), quoted(x["content"]))), "\n"))
    as_json = F.to_json(F.struct("session_id", "platform", "title", F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    texts = {"md": F.concat(front, contents, body), "txt": plain, "json": as_json, "csv": csv}
    every = F.explode(F.array(*(F.struct(file_name(platform, title, day, f).alias("name"), F.lit(f).alias("format"), t.alias("text")) for f, t in texts.items())))
    return rows.select("session_id", every.alias("x")).select("session_id", "x.name", "x.format", "x.text")
