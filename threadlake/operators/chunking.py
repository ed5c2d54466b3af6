"""Messages to chunks: code blocks whole, prose cleaned and packed by sentences. All in the JVM, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.functions.text import FENCE, cleaned, stripped, token_estimate

TARGET_CHARS, LEAST_CHARS, NEWEST = 800, 20, 2000
_SENTENCE = r"(?<=[.!?])\s+"
#: Marks where a part begins and where a fence's language ends; taken out of contents first.
_PART, _LANGUAGE = "\x01", "\x02"


def message_parts(messages: DataFrame) -> DataFrame:
    """messages with part_index, is_code, language and text of each stretch of prose or fenced block, in place of content."""
    plain = F.regexp_replace("content", f"[{_PART}{_LANGUAGE}]", "")
    marked = F.concat(F.lit("p"), F.regexp_replace(plain, FENCE, f"{_PART}c$1{_LANGUAGE}$2{_PART}p"))
    rows = messages.select(*[c for c in messages.columns if c != "content"], F.posexplode(F.split(marked, _PART)).alias("part_index", "part"))
    is_code = F.col("part").startswith("c")
    rows = rows.withColumn("is_code", is_code)
    rows = rows.withColumn("language", F.when(is_code, F.nullif(F.expr(f"substring(substring_index(part, '{_LANGUAGE}', 1), 2)"), F.lit(""))))
    text = F.when(is_code, F.substring_index("part", _LANGUAGE, -1)).otherwise(F.expr("substring(part, 2)"))
    return rows.withColumn("text", text).filter("is_code OR text <> ''").drop("part")


def packed(text: Column, target: int = TARGET_CHARS) -> Column:
    """Sentences packed in order while a pack and the next one, without the space between, have target characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, sentence: Column) -> Column:
        full = (F.length(state["open"]) + F.length(sentence) > target) & (state["open"] != "")
        more = F.concat(state["open"], F.when(state["open"] != "", F.lit(" ")).otherwise(""), sentence)
        return F.struct(F.when(full, F.array_append(state["done"], stripped(state["open"]))).otherwise(state["done"]).alias("done"), F.when(full, sentence).otherwise(more).alias("open"))

    def finish(state: Column) -> Column:
        return F.when(stripped(state["open"]) != "", F.array_append(state["done"], stripped(state["open"]))).otherwise(state["done"])

    return F.when(F.length(text) <= target, F.array(text)).otherwise(F.aggregate(F.split(text, _SENTENCE), start, step, finish))


def chunk_messages(messages: DataFrame, newest: int = NEWEST) -> DataFrame:
    """(session_id, message_index, part_index, piece_index, role, text, has_code, language, token_count) of messages
    (session_id, message_index, role, content), of each session the newest ones. Null and empty contents give none."""
    rows = message_parts(messages.select("session_id", "message_index", "role", "content").filter("content <> ''"))
    code = rows.filter(F.col("is_code") & (stripped(F.col("text")) != "")).withColumn("piece_index", F.lit(0))
    prose = rows.filter("NOT is_code").withColumn("text", cleaned(F.col("text"))).filter(F.length("text") >= LEAST_CHARS)
    prose = prose.select("session_id", "message_index", "role", "part_index", "is_code", "language", F.posexplode(packed(F.col("text"))).alias("piece_index", "text"))
    prose = prose.filter(F.length(stripped(F.col("text"))) >= LEAST_CHARS)
    every = code.unionByName(prose).select("session_id", "message_index", "part_index", "piece_index", "role", "text", F.col("is_code").alias("has_code"), "language", token_estimate(F.col("text")).alias("token_count"))
    # One task ranks a session's chunks: Spark cuts ranks before the shuffle up to spark.sql.optimizer.windowGroupLimitThreshold
    # only, 1000 unless set; where sessions are huge, set it to `newest`.
    late = Window.partitionBy("session_id").orderBy(F.desc("message_index"), F.desc("part_index"), F.desc("piece_index"))
    return every.withColumn("r", F.row_number().over(late)).filter(F.col("r") <= newest).drop("r")


def sample_positions(n: Column, most: int) -> Column:
    """Of n items in order, the places of the first tenth, an even stride of the middle and the last 40 % of `most`."""
    first, recent = int(most * 0.10), int(most * 0.40)
    middle = most - first - recent
    stride = (n - recent - first) / middle
    between = F.transform(F.sequence(F.lit(0), F.lit(middle - 1)), lambda i: F.floor(first + i * stride))
    some = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.lit(max(first - 1, 0))), lambda i: i.cast("bigint")), between, F.transform(F.sequence(F.lit(0), F.lit(recent - 1)), lambda i: (n - recent + i).cast("bigint"))))
    return F.when(n > most, F.array_sort(some)).otherwise(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>")))


def file_chunks(files: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """(file_id, chunk_index, start, text) of files (file_id, text): stretches of size characters that overlap."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))
    cut = files.filter("text <> ''").select("file_id", "text", F.posexplode(starts).alias("chunk_index", "start"))
    return cut.select("file_id", "chunk_index", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))
