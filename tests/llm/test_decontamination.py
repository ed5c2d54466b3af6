import random
import re

from tests.llm.oracle import same
from threadlake.llm import decontamination, queries, sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, width=10):
    ws, hit, found = split(text), set(), set()
    for item, t in items:
        words = split(t)
        n = min(width, len(words))
        for o in range(len(words) - n + 1) if words and item is not None else ():
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == words[o : o + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(ws), len(hit), sorted(found), bool(hit)


def test_same_as_brute_force(spark):
    draw = random.Random(8)
    word = lambda: draw.choice(["the", "of", "and", "a", *(f"wörd{k}" for k in range(60))])
    some = lambda n: [word() for _ in range(n)]
    long, short = some(40), some(4)
    items = [(1, " ".join(long)), (2, " ".join(short).upper()), (10, "the The"), (3, ""), (4, None), (None, "of of"), (5, " ".join(long[5:30])), (5, " ".join(some(12))), (6, "a " * 30), (6, "a " * 30), (7, "ÉA, éa!")]
    texts = ["", None, "  !!", "the", "THE the-the", "a " * 25, "a " * 9, "Éa éA", " ".join(long), ",".join(long[:12]), " ".join([*some(20), *long[3:19], *some(9)]), " ".join(long[:9]), " ".join([*short, *short]).title()]
    texts += [" ".join([*some(20), *long[k : k + draw.randrange(14)], *some(5)]) for k in range(30)] + [" ".join([*some(3000), *long, *long])]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(8, texts[8], "x"), (None, texts[8], "x")], "doc_id long, text string, item string").repartition(3)
    got = decontamination.contamination(docs, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, words int")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[8 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute(text, items), text


def test_rows_are_told_apart_by_id_and_text(spark):
    """Null ids and ids with several texts: each row is judged by its own text, and goes or stays by itself."""
    hit, clean = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine"
    rows = [(None, hit), (None, clean), (None, hit), (1, hit), (1, clean), (2, clean), (2, clean), (3, None), (None, None)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, id long, _doc string")
    items = spark.createDataFrame([(1, "ZERO " + hit)], "item_id long, text string")
    got = decontamination.contamination(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == sorted((str(i), len(split(t)), 10 if t == hit else 0) for i, t in rows)
    left = decontamination.without_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted((str(i), str(t)) for i, t in rows if t != hit)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "gamma beta alpha")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start) for r in decontamination.proximity(docs, items, span=6).collect()] == [(1, "9", 0)]


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.contamination(none, item).count() == 0
    assert not decontamination.contamination(one, item.limit(0)).first().contaminated


def test_same_as_sql(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        same(queries.op7_decontamination(spark, d), sql.DECONTAMINATION, d)
        assert queries.op7_decontamination(spark, d).filter("contaminated").count() > 0
