"""Quality of a compressed session against its original, and reports over such records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# FIXED values: how a message's role shows in an output, for platforms without forms of their own; grades by score.
ROLE_MARKS = {
    "user": [r'(?i)<message role="user">', r"(?i)\*\*(?:You|User):\*\*", r"(?im)^\s*(?:You|User):", r"(?i)\[USER\]", r'(?i)role="user"'],
    "assistant": [r'(?i)<message role="assistant">', r"(?i)\*\*(?:AI|Assistant|Grok|Claude|Gemini|Previous AI):\*\*", r"(?im)^\s*(?:AI|Assistant):", r"(?i)\[ASSISTANT\]", r'(?i)role="assistant"'],
}
GRADES = [(90, "Excellent"), (75, "Good"), (60, "Acceptable"), (40, "Poor")]
#: Signals of decisions, bugs, goals and facts; each counts for itself, so that some phrases count twice.
SIGNALS = [
    r"(?i)\bwe decided\b", r"(?i)\bdecided to\b", r"(?i)\bgoing with\b", r"(?i)\bopted for\b", r"(?i)\bwe('?ll| will) use\b", r"(?i)\bchose to\b", r"(?i)\bwe chose\b", r"(?i)\bswitching to\b", r"(?i)\bmigrating to\b", r"(?i)\bbest approach\b",
    r"(?i)\bthe approach is\b", r"(?i)\bwe use\b", r"(?i)\busing\b", r"(?i)\bwent with\b", r"(?i)\bthe (fix|bug|issue|problem|root cause)\b", r"(?i)\broot cause\b", r"(?i)\bthe fix\b", r"(?i)\bfixed by\b", r"(?i)\bbug was\b", r"(?i)\berror occurs\b",
    r"(?i)\bissue was\b", r"(?i)\bresolved by\b", r"(?i)\bfound it\b", r"(?i)\bthe goal\b", r"(?i)\bour goal\b", r"(?i)\bwe want to\b", r"(?i)\bwe need to\b", r"(?i)\bwe('?re| are) building\b", r"(?i)\bthe plan\b", r"(?i)\bnext step\b",
    r"(?i)\bthis works because\b", r"(?i)\bthe reason\b", r"(?i)\bbecause of\b", r"(?i)\bturns out\b", r"(?i)\brealized that\b", r"(?i)\barchitecture\b", r"(?i)\bwe chose\b", r"(?i)\bwe('?re| are) going with\b", r"(?i)\bdecision\b", r"(?i)\bcompleted\b",
    r"(?i)\bpending\b", r"(?i)\btodo\b",
]


def rounded(x: Column) -> Column:
    """To one decimal, halves upwards; what is negative, null or no number gives 0."""
    return F.when(F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)), F.greatest(F.lit(0.0), F.floor(x * 10 + 0.5) / 10)).otherwise(0.0)


def part(share: Column, most: float) -> Column:
    return rounded(F.greatest(F.lit(0.0), F.least(share * most, F.lit(float(most)))))


def grade(score: Column) -> Column:
    return F.coalesce(*(F.when(score >= least, F.lit(name)) for least, name in GRADES), F.lit("Failed"))


def marked(output: Column, role: str) -> Column:
    return F.greatest(*(F.regexp_count(output, F.lit(p)) for p in ROLE_MARKS[role]))


def code_blocks(text: Column) -> Column:
    tags = F.regexp_count(text, F.lit(r"(?i)<code[^>]*>")) + F.regexp_count(text, F.lit(r"(?i)<(?:file|snippet)\s"))
    return F.greatest(F.floor(F.regexp_count(text, F.lit("```")) / 2), tags)


def signals(text: Column, patterns: list[str] = SIGNALS) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(p))
    return total


def scores(messages: DataFrame, outputs: DataFrame, patterns: list[str] = SIGNALS) -> DataFrame:
    """(session_id, tier, parts, score, grade) of outputs (session_id, tier, top_k, output) against messages: survival /25,
    code /20, roles /15, freshness /15, signals /15 and compression /10. Messages are aggregated once; what has to be
    looked for in the output, the last six messages and the first fifty's signals, is all that is kept of their texts."""
    content = F.coalesce("content", F.lit(""))
    own = Window.partitionBy("session_id")
    rows = messages.withColumn("content", content).withColumn("_back", F.row_number().over(own.orderBy(F.desc("message_index"))))
    rows = rows.withColumn("_first", F.row_number().over(own.orderBy("message_index")))
    sessions = rows.groupBy("session_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("role").isin("user", "assistant")).alias("valid"),
        F.sum(F.regexp_count("content", F.lit("```"))).alias("fences"),
        F.sum(F.when(F.col("_first") <= 50, signals(F.col("content"), patterns)).otherwise(0)).alias("signals"),
        F.collect_list(F.when(F.col("_back") <= 6, F.trim(F.substring("content", 1, 60)))).alias("tail"),
    )
    met = outputs.join(sessions, "session_id")
    out = F.col("output")
    kept = marked(out, "user") + marked(out, "assistant")
    ratio = F.least("n", kept) / F.col("n")
    had = F.floor(F.col("fences") / 2)
    code = F.when(had > 0, F.least(code_blocks(out) / had, F.lit(1.0)) * 20).otherwise(20.0)
    code = rounded(F.greatest(F.lit(0.0), code - F.when(F.regexp_count(out, F.lit("```")) % 2 == 1, 5).otherwise(0)))
    present = F.size(F.filter("tail", lambda f: (f == "") | out.contains(f)))
    fresh = F.when(present >= 6, 15.0).when(present >= 4, 10.0).when(present >= 2, 5.0).otherwise(0.0)
    signal = F.when(F.col("signals") > 0, part(F.least("signals", signals(out, patterns)) / F.col("signals"), 15)).otherwise(15.0)
    percent = kept / F.col("n") * 100
    second = F.when((percent >= 70) & (percent < 90), 10.0).when(percent >= 90, 8.0).when(percent >= 50, 6.0).otherwise(3.0)
    third = F.when(F.coalesce("top_k", F.lit(0)) >= 15, 10.0).when(F.coalesce("top_k", F.lit(0)) >= 10, 7.0).otherwise(4.0)
    parts = {"survival": part(ratio, 25), "code": code, "roles": part(F.col("valid") / F.col("n"), 15), "freshness": fresh, "retention": signal, "compression": F.when(F.col("tier") == 1, 10.0).when(F.col("tier") == 2, second).otherwise(third)}
    met = met.select("session_id", "tier", *(c.alias(name) for name, c in parts.items()))
    total = F.floor(sum((F.col(name) for name in parts), F.lit(0.0)) + 0.5).cast("bigint")
    return met.withColumn("score", total).withColumn("grade", grade(F.col("score")))


def weakest(records: DataFrame, most: dict[str, float]) -> DataFrame:
    """(dimension, average, share): the averages of a record's parts, the weakest by its share of what is possible first."""
    means = records.agg(*(F.avg(name).alias(name) for name in most)).select(F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(n).alias("average"), (F.col(n) / m).alias("share")) for n, m in most.items()))).alias("x"))
    return means.select("x.*").orderBy("share", "dimension")
