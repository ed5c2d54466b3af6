"""Quality rules: counts for each text, and limits that adapt to language and source.

All work is DataFrame functions. The counts of every text are written once to the shared folder. From them, a
mergeable quantile sketch is kept for each language, source and rate: counts of logarithmic buckets, whole numbers
below 128 exactly and larger ones to within one part in 64. Sketches merge by adding counts, so Spark adds them
before its shuffle, and the sketch of a language is the sum of those of its sources. A text is rejected if a rate
lies outside quartile fences of its own group; a group of fewer than MIN_GROUP texts takes its language's sketch,
and a small language that of the whole table. Limits are joined to texts with a salted key, so a source that holds
a third of the rows is spread over SALTS parts.

Results: a null or empty text has zero counts and fails; a null language or source counts as the empty string;
repeated rows are each judged and each count in the sketches; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.llm.storage import durable

MIN_GROUP = 50
SALTS = 16
#: Rate in thousandths of a word: name, least distance of the fence from the quartile, whether there is a lower fence.
RATES = (("symbol_rate", 100, False), ("dup_line_rate", 100, False), ("repeat_rate", 200, False), ("word_length", 500, True))
FENCE = 3
_SPACE = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, though body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{_SPACE}]+"))


def _covered(starts: Column, width: int) -> Column:
    """Words under windows that begin at these sorted places."""
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), step, lambda a: a["n"].cast("bigint"))


def _repeated(ws: Column, width: int) -> Column:
    """Words in windows that occur twice or more. A window is known by 64 bits of hash within its own text."""
    starts = F.when(F.size(ws) >= width, F.sequence(F.lit(1), F.size(ws) - width + 1)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, width)))

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("k"), i.alias("p"))))

        def twins(s: Column) -> Column:
            same = lambda i, j: F.try_element_at(s, j + 1)["k"].eqNullSafe(F.element_at(s, i + 1)["k"])
            marks = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))) | same(i, i + 1))
            return F.sort_array(F.transform(marks, lambda i: F.element_at(s, i + 1)["p"]))

        return _covered(let(ordered, twins), width)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(places(h)))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 8) -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each whole text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), blank("lang").alias("lang"), blank("source").alias("source"), blank(text_col).alias("text"))
    lines = let(
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{_SPACE}]")),
        lambda x: F.size(x) - F.size(F.array_distinct(x)),
    )
    per_words = let(
        words(F.col("text")),
        lambda ws: F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"),
            _repeated(ws, width).alias("n_repeat_words"),
        ),
    )
    found = rows.select(
        id_col, "lang", "source", per_words.alias("w"),
        (F.size(F.split("text", "[#*$%&|<>]", -1)) - 1).cast("bigint").alias("n_symbols"),
        lines.cast("bigint").alias("n_dup_lines"),
    )
    return found.select(id_col, "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def _rates() -> list[Column]:
    per = lambda c: F.expr(f"{c} * 1000 div n_words")
    return [per(c) for c in ("n_symbols", "n_dup_lines", "n_repeat_words", "word_chars")]


def sketch(found: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): mergeable sketches; texts without words have no rates."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), r.alias("x")) for k, r in enumerate(_rates()))))
    rows = found.filter("n_words > 0").select("lang", "source", values.alias("v")).select("lang", "source", "v.rate", "v.x")
    bucket = F.expr("CASE WHEN x < 128 THEN x ELSE (length(bin(x)) - 7) * 64 + shiftright(x, length(bin(x)) - 7) END")
    return rows.groupBy("lang", "source", "rate", bucket.cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, total, low, high) of sketches merged by keys."""
    merged = sketches.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rate")
    ranked = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    value = lambda b: F.expr(f"CASE WHEN {b} < 128 THEN {b} ELSE shiftleft({b} - ({b} div 64 - 1) * 64, CAST({b} div 64 - 1 AS INT)) END")
    firsts = ranked.groupBy(*keys, "rate").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("b1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("b3"),
    )
    return firsts.select(*keys, "rate", "total", value("b1").alias("low"), value("b3").alias("high"))


def limits(sketches: DataFrame) -> DataFrame:
    """(lang, source, least_0.., most_0..): the fences of each group."""
    levels = quartiles(sketches, ["lang", "source"])
    for n, keys in ((1, ["lang"]), (2, [])):
        wider = quartiles(sketches, keys).select(*keys, "rate", *(F.col(c).alias(f"{c}_{n}") for c in ("total", "low", "high")))
        levels = levels.join(wider, [*keys, "rate"])
    pick = lambda c: F.when(F.col("total") >= MIN_GROUP, F.col(c)).when(F.col("total_1") >= MIN_GROUP, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    levels = levels.select("lang", "source", "rate", pick("low").alias("low"), pick("high").alias("high"))
    fences = []
    for k, (_, slack, lower) in enumerate(RATES):
        span = F.greatest((F.col("high") - F.col("low")) * FENCE, F.lit(slack))
        mine = lambda c, k=k: F.max(F.when(F.col("rate") == k, c))
        fences.append(mine(F.col("high") + span).alias(f"most_{k}"))
        if lower:
            fences.append(mine(F.col("low") - span).alias(f"least_{k}"))
    return levels.groupBy("lang", "source").agg(*fences)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each text with base_failed, the fixed rules, and kept, after the adaptive ones too."""
    found = durable(counts(docs, id_col, text_col), "rule-counts")
    fences = limits(sketch(found)).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = found.select("*", F.pmod(F.xxhash64(id_col, "n_words", "word_chars"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = salted.join(fences, ["lang", "source", "salt"], "left")
    inside = F.lit(True)
    for k, ((_, _, lower), rate) in enumerate(zip(RATES, _rates())):
        inside &= rate <= F.col(f"most_{k}")
        if lower:
            inside &= rate >= F.col(f"least_{k}")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return joined.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(inside).alias("kept"),
    )
