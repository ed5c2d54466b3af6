"""Validation, resolution, reports and exports of sessions and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.functions.text import collapsed
from threadlake.operators.summaries import TECHNOLOGIES

# FIXED values: limits of platforms in tokens, warnings of quality records.
TOKEN_LIMITS = {"claude": 180_000, "chatgpt": 100_000, "gemini": 900_000, "grok": 100_000, "perplexity": 60_000, "deepseek": 100_000}
OTHER_LIMIT, WARN_AT = 80_000, 0.80
WARNINGS = [("survival", 15, "Low message survival — check compression"), ("integrity", 12, "Code blocks lost or truncated"), ("freshness", 10, "Recent messages not preserved"), ("retention", 8, "Key decisions / signals dropped")]


def valid_messages(messages: DataFrame) -> DataFrame:
    """Messages of the two roles with a content."""
    return messages.filter(F.col("role").isin("user", "assistant") & F.col("content").isNotNull())


def valid_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with an id and a well-formed platform; a missing title is the id, a long one is cut."""
    good = sessions.filter(F.col("session_id").isNotNull() & F.col("platform").rlike("^(?i:[a-z0-9_-]{2,32})$"))
    return good.withColumn("title", F.substring(F.coalesce("title", F.col("session_id").cast("string")), 1, 500))


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with id, text and place whose vector, without its nulls, has numbers."""
    return chunks.withColumn("embedding", F.filter("embedding", lambda x: x.isNotNull())).filter("chunk_id IS NOT NULL AND text IS NOT NULL AND message_index IS NOT NULL AND size(embedding) > 0")


def chunks_of_messages(messages: DataFrame, chunks: DataFrame, *on: str) -> DataFrame:
    """messages with the first chunk of the same content, by `on`, if there is one."""
    first = chunks.groupBy(*on).agg(F.min("chunk_id").alias("chunk_id"))
    return messages.join(first, list(on), "left")


def touched(modules: DataFrame, files: DataFrame) -> DataFrame:
    """modules (name, files) that have one of files (file): by exploding to an equi-join, not by comparing all pairs."""
    return modules.select("name", F.explode("files").alias("file")).join(files.select("file").distinct(), "file", "left_semi").select("name").distinct()


def resolved_templates(sessions: DataFrame, assignments: DataFrame, default: str | None) -> DataFrame:
    """sessions (session_id, platform) with template_id: the first assignment to the session, else to its platform, else
    the default. assignments (id, template_id, session_id, platform)."""
    own = assignments.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.min_by("template_id", "id").alias("_own"))
    shared = assignments.filter("platform IS NOT NULL").groupBy("platform").agg(F.min_by("template_id", "id").alias("_shared"))
    met = sessions.join(own, "session_id", "left").join(shared, "platform", "left")
    return met.withColumn("template_id", F.coalesce("_own", "_shared", F.lit(default))).drop("_own", "_shared")


def warnings(breakdown: dict[str, Column]) -> Column:
    """The warnings of a quality record by its parts."""
    return F.array_compact(F.array(*(F.when(breakdown[part] < least, F.lit(text)) for part, least, text in WARNINGS if part in breakdown)))


def budgeted_blocks(blocks: DataFrame, most: int, head: int, tail: int, joint: int = 2) -> DataFrame:
    """blocks (session_id, place, size) that stay when the oldest ones between head and tail go until the whole, with
    `joint` characters between blocks, has at most `most`."""
    own = Window.partitionBy("session_id")
    n = F.count("*").over(own)
    rows = blocks.withColumn("_n", n).withColumn("_part", F.when(F.col("place") < head, "head").when(F.col("place") >= F.col("_n") - tail, "tail").otherwise("middle"))
    edges = F.sum(F.when(F.col("_part") != "middle", F.col("size") + joint).otherwise(0)).over(own)
    later = F.sum(F.when(F.col("_part") == "middle", F.col("size") + joint).otherwise(0)).over(own.orderBy(F.desc("place")))
    rows = rows.withColumn("_whole", edges + later - joint)
    return rows.filter((F.col("_part") != "middle") | (F.col("_whole") <= most)).drop("_n", "_part", "_whole")


def newest(rows: DataFrame, n: int, by: str, at: str, tie: str) -> DataFrame:
    """The n newest rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie)))).filter(F.col("_r") <= n).drop("_r")


def smallest(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows that come first by the columns of `by` (numbers, dates or times; nulls first), by aggregates only: no row is
    sorted. Rows that are equal in all of them go together, so that more than k can come."""
    if k <= 0:
        return rows.limit(0)
    c = F.col(by[0])
    n_null, n = rows.agg(F.count_if(c.isNull()), F.count("*")).first()
    if k >= n:
        return rows
    if k <= n_null:
        last, below, at = n_null, 0, c.isNull()
        before = F.lit(False)
    else:
        # Each round cuts what is left to about a ten-thousandth; of fewer rows than that the percentile is exact.
        rest, passed, v = rows.filter(c.isNotNull()), n_null, None
        left = n - n_null
        while True:
            v = rest.agg(F.percentile_approx(c, F.lit((k - passed) / left), F.lit(10_000))).first()[0]
            under, upto = rest.agg(F.count_if(c < F.lit(v)), F.count_if(c <= F.lit(v))).first()
            if passed + under < k <= passed + upto:
                break
            if k <= passed + under:
                rest, left = rest.filter(c < F.lit(v)), under
            else:
                rest, passed, left = rest.filter(c > F.lit(v)), passed + upto, left - upto
        last, below, at = passed + upto, passed + under, c == F.lit(v)
        before = F.coalesce(c < F.lit(v), F.lit(True))
    if last == k or len(by) == 1:
        return rows.filter(before | at)
    return rows.filter(before).unionByName(smallest(rows.filter(at), by[1:], k - below))


def evicted(rows: DataFrame, limit: int, at: str, tie: str, share: float = 0.2) -> DataFrame:
    """Of more than `limit` rows the oldest share: those to be removed. Rows alike in `at` and `tie` go together."""
    n = rows.count()
    return smallest(rows, [at, tie], int(n * share)) if n > limit else rows.limit(0)


def sentence(text: Column, most: int = 280) -> Column:
    """The first sentence of 8 to 300 characters outside code, or else all of it, cut to `most`."""
    plain = collapsed(F.regexp_replace(text, "(?s)```.*?```", " "))
    found = F.regexp_extract(plain, r"([^.?!]{8,300}[.?!])", 1)
    chosen = F.trim(F.when(found != "", found).otherwise(plain))
    return F.when(F.length(chosen) > most, F.concat(F.substring(chosen, 1, most - 3), F.lit("…"))).otherwise(chosen)


def technologies(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(name)) for p, name in TECHNOLOGIES)))


def module_type(path: Column, functions: Column, classes: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.rlike(r"\.test\.|\.spec\.|__tests__"), "test").when(p.rlike(r"config|settings|\.env"), "config")
        .when(p.rlike(r"components?/|\.tsx$") | F.exists(classes, lambda c: c.rlike("Props|Component")), "component").when(p.rlike("service|api|client|fetch|http"), "service")
        .when(p.rlike("util|helper|lib/|shared"), "util").when((F.size(functions) > 0) & (F.size(classes) == 0), "util").otherwise("unknown")
    )


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, F.concat(F.format_string("%.1f", n / 1024), F.lit("KB"))).otherwise(F.concat(F.format_string("%.1f", n / (1 << 20)), F.lit("MB")))


def token_warnings(usage: DataFrame) -> DataFrame:
    """usage (platform, chars) with tokens, percent and level: 'over', 'large' or null."""
    limit = F.coalesce(reduce(lambda a, b: F.when(F.col("platform") == b[0], b[1]).otherwise(a), TOKEN_LIMITS.items(), F.lit(None).cast("int")), F.lit(OTHER_LIMIT))
    tokens = F.ceil(F.col("chars") / 4).cast("bigint")
    rows = usage.withColumn("tokens", tokens).withColumn("percent", F.floor(F.col("tokens") * 100 / limit + 0.5).cast("bigint"))
    return rows.withColumn("level", F.when(F.col("tokens") >= limit, "over").when(F.col("tokens") >= WARN_AT * limit, "large"))


def long_words(text: Column) -> Column:
    """The words of over four letters, in small letters."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) > 4)


def like_enough(words: Column, lower: Column, share: float = 0.6) -> Column:
    """Whether a share of an item's long_words occurs in a text that is in small letters; true without such words."""
    hits = F.size(F.filter(words, lambda w: lower.contains(w)))
    return F.when(F.size(words) == 0, True).otherwise(hits / F.size(words) >= share)


def csv_field(text: Column) -> Column:
    """Quoted where it must be, with quotes doubled."""
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), doubled).otherwise(text)


def joined(rows: DataFrame, key: str, order: str, line: Column, separator: str, header: str = "") -> DataFrame:
    """(key, text): each key's lines in order, for a text export of whole sessions."""
    lines = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]).alias("l"))
    return lines.select(key, F.concat(F.lit(header), F.array_join("l", separator)).alias("text"))


def markdown(messages: DataFrame) -> DataFrame:
    line = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    return joined(messages, "session_id", "message_index", line, "\n\n")


def csv(messages: DataFrame) -> DataFrame:
    line = F.concat_ws(",", F.col("message_index").cast("string"), csv_field(F.col("role")), csv_field(F.coalesce("content", F.lit(""))))
    return joined(messages, "session_id", "message_index", line, "\r\n", "index,role,content\r\n")
