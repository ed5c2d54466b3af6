import re
from collections import Counter

from tests.llm.oracle import same
from threadlake.llm import queries, rules, sql

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    ws = [w for w in SPACE.split(text or "") if w]
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    texts = ["", None, " \t\n", "a b c d e f g h a b c d e f g h", "x " * 40, "a\n\na\n b\n b\na \n", "é ñ #*$ |<>\x0b\x0c z\x85q r", long, "\n".join(["same line here"] * 9), "a b c d e f g h i a b c d e f g h i j"]
    rows = spark.createDataFrame([(i, t, None if i % 2 else "en", "s", 7) for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang string, source string, n_words int")
    for r in rules.counts(rows).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id] and texts[r.doc_id][:40]
    judged = rules.judge(rows).collect()
    assert len(judged) == 2 * len(texts) and all(r.kept in (True, False) for r in judged)
    assert not any(r.kept for r in judged if not texts[r.doc_id])


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert rules.judge(none).count() == 0


def test_same_as_sql(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        same(queries.op8_rules(spark, d), sql.RULES, d)


def test_clean_texts_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op8_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("n_words >= 20").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad), (sum(good), len(good), sum(bad), len(bad))
