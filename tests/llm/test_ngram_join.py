"""Classes against brute force over all pairs of sets."""

import random

import numpy as np
import pytest

from threadlake.llm import ngram_join, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    own = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and own[i] != own[j] and sets[i] and min(len(sets[i]), len(sets[j])) * 100 >= 90 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = own[i], own[j]
                    own = [a if x == b else x for x in own]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[own[k]] = min(i, least.get(own[k], i))
    return sorted(((i, len(s), least[own[k]] if i is not None else None) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in ngram_join.alike(df, **how).collect()), key=repr) == brute(rows)


def variants(draw, n, words, edits, tag="w"):
    base = [f"{tag}{draw.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(draw.randint(0, edits)):
            text[draw.randrange(words)] = f"x{draw.randrange(10_000)}"
        out.append(" ".join(text))
    return out


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op12_ngram_join(spark, SF).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("cell", [1 << 20, 3000])
def test_chains_of_variants(spark, monkeypatch, cell):
    """Cells that are cut by size and salted give the same classes."""
    monkeypatch.setattr(ngram_join.cells, "__defaults__", (cell,))
    draw = random.Random(3)
    texts = variants(draw, 60, 120, 4) + variants(draw, 40, 200, 8, "y") + variants(draw, 30, 12, 1, "z") + [" ".join(f"u{draw.randrange(50)}" for _ in range(40)) for _ in range(50)]
    check(spark, list(enumerate(texts)))


def test_small_blocks_and_steps():
    """Every pair at the border of similarity, in tries of any step."""
    draw, old = random.Random(9), ngram_join.STEP
    for step in (1, 7, 64):
        ngram_join.STEP = step
        for _ in range(30):
            pool = list(range(draw.choice([30, 60])))
            sets = {tuple(sorted(draw.sample(pool, draw.randint(20, 30)))) for _ in range(25)}
            sets = sorted(sets)
            arrays = [np.array(s, np.uint64) for s in sets]
            own = list(range(len(sets)))
            for i in range(len(sets)):
                for j in range(i):
                    both = len(set(sets[i]) & set(sets[j]))
                    if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                        own = [own[i] if x == own[j] else x for x in own]
            got = list(range(len(sets)))
            found = ngram_join.trie_links(arrays)
            for a, b in found:
                assert got[a] != got[b]
                got = [got[a] if x == got[b] else x for x in got]
            same = lambda x: [x.index(v) for v in x]
            assert same(own) == same(got)
    ngram_join.STEP = old


def test_odd_rows(spark):
    """Nulls, empty, short and very long texts, repeated rows, ids with several texts, capitals, other white space."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a b"), (6, "b a"), (7, "a b c d"), (8, "a b\vc"), (9, "A B C"), (9, "z y x w"), (9, "z y x w"), (10, "Z y\nx w"), (None, "a b c"), (11, long), (12, long + " end"), (13, "İ Ét É"), (14, "İ ét É")]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert ngram_join.alike(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(4, "a b c d", 1, "k"), (3, "a b c d", 2, "l")], "doc_id long, text string, node long, key string")
    assert sorted(map(tuple, ngram_join.alike(df).collect())) == [(3, 2, 3), (4, 2, 3)]
