import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.oracle import same
from threadlake.llm import fm_index, queries, sql, substrings

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def removed(rows, width, across):
    first, out = {}, {}
    ordered = sorted((i, split(t)) for i, t in rows if i is not None)
    for d, ws in ordered:
        for p in range(len(ws) - width + 1):
            first.setdefault(tuple(ws[p : p + width]), (d, p))
    for d, ws in ordered:
        gone = set()
        for p in range(len(ws) - width + 1):
            at = first[tuple(ws[p : p + width])]
            if (at[0] < d) if across else at < (d, p):
                gone.update(range(p, p + width))
        out[d] = gone
    return out


def odd_rows():
    draw = random.Random(4)
    new = lambda n: " ".join(f"w{draw.randrange(4000)}é" for _ in range(n))
    shared, licence = new(70), new(60)
    rows = [(k, f"{new(draw.randrange(90))}\n{licence if k % 3 == 0 else ''}\t{shared[: draw.randrange(len(shared))]} {new(draw.randrange(80))}") for k in range(120)]
    rows += [(200, "a " * 900), (201, "a " * 40), (202, "x y " * 300), (203, ""), (204, None), (205, " \n\t"), (206, new(25_000)), (207, "one two")]
    rows += [(300 + k, rows[5][1]) for k in range(40)] + [(400, rows[206 - 80][1])]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = odd_rows()
    extra = [(i, t, "id", "words") for i, t in [*rows, (None, rows[5][1])]]
    return rows, spark.createDataFrame(extra, "doc_id long, text string, id string, runs string").repartition(3)


def test_windows(table):
    rows, docs = table
    expected, texts = removed(rows, 13, True), dict(rows)
    got = substrings.without_earlier_windows(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        ws = split(texts[5 if r.doc_id is None else r.doc_id])
        gone = set() if r.doc_id is None else expected[r.doc_id]
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()), r.doc_id
        assert {p for s in r.spans for p in range(s.start, s.end)} == gone


def test_passages(table):
    rows, docs = table
    expected, words = removed(rows, 50, False), {i: split(t) for i, t in rows}
    covered = {i: set() for i in words}
    for r in substrings.repeated_passages(docs).collect():
        assert words[r.doc_id][r.start : r.start + 50] == words[r.first_doc_id][r.first_start : r.first_start + 50]
        assert (r.first_doc_id, r.first_start) < (r.doc_id, r.start) and r.n_words >= 50
        covered[r.doc_id].update(range(r.start, r.start + r.n_words))
    assert covered == expected


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, " ".join(map(str, range(60)))), (2, " ".join(map(str, range(60))))] * 2
    got = substrings.without_earlier_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 60), (2, 60)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.without_earlier_windows(none).count() == 0
    assert substrings.repeated_passages(none).count() == 0


def test_texts_of_one_id_are_told_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = substrings.without_earlier_windows(spark.createDataFrame([(1, a), (2, f"{a} {b}"), (2, b), (3, b), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 40, 0), (2, 0, 0), (2, 40, 0), (2, 80, 40), (3, 40, 40)]


def test_wide_windows(spark):
    rows = [(1, " ".join(map(str, range(700)))), (2, " ".join(map(str, range(100, 600)))), (3, " ".join(map(str, range(249))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.without_earlier_windows(docs, width=250).collect()) == [(1, 0), (2, 500), (3, 0)]
    assert [(r.doc_id, r.start, r.n_words) for r in substrings.repeated_passages(docs, width=300).collect()] == [(2, 0, 500)]


def test_index_finds_patterns():
    draw = np.random.default_rng(2)
    text = np.append(draw.integers(1, 6, 3000), 0)
    index = fm_index.FmIndex(text, 5)
    for _ in range(300):
        pattern = draw.integers(1, 6, draw.integers(1, 6))
        low, high = np.array([0]), np.array([len(text)])
        for s in pattern[::-1]:
            low, high = index.extend(np.array([s]), low, high)
        places = [p for p in range(len(text)) if text[p : p + len(pattern)].tolist() == pattern.tolist()]
        assert sorted(index.places[low[0] : high[0]]) == places


def test_same_as_sql(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        same(queries.op4_substrings(spark, d), sql.SUBSTRINGS, d)
