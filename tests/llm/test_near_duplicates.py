import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from threadlake.llm import components, near_duplicates, queries

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def bag(text):
    ws = [w for w in SPACE.split(text or "") if w]
    n = min(5, len(ws))
    return Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if n else Counter()


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute(rows, least=0.8):
    """The classes, by all pairs that share a shingle."""
    bags = {i: bag(t) for i, t in rows if i is not None}
    of, where = {i: i for i in bags}, {}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    n = 0
    for i, b in bags.items():
        for j in {j for s in b for j in where.get(s, ())}:
            if jaccard(b, bags[j]) >= least:
                x, y = sorted((root(i), root(j)))
                of[y] = x
                n += 1
        for s in b:
            where.setdefault(s, []).append(i)
    return {i: root(i) for i in bags}, n


def test_classes_as_by_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    expected, n = brute(rows)
    assert n > 20
    assert {r.doc_id: r.class_id for r in queries.op1_near_duplicates(spark, d).collect()} == expected


def test_odd_rows(spark):
    draw = random.Random(6)
    base = [f"w{draw.randrange(900)}" for _ in range(200)]
    near = lambda n: " ".join(w if k not in places else "new" + str(draw.random()) for k, w in enumerate(base)) if (places := set(draw.sample(range(200), n))) is not None else ""
    texts = ["", None, " \n ", "one", "one", "two words", "two  words", "a " * 3000, "a " * 3100, "a " * 900, " ".join(base)] + [near(1 + k % 4) for k in range(60)]
    texts += [" ".join(f"x{k}" for k in range(25_000))] * 2
    rows = list(enumerate(texts)) + [(None, texts[10]), (None, None)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in [*rows, (10, texts[10])]], "doc_id long, text string, class_id int").repartition(3)
    got = near_duplicates.near_duplicates(docs).collect()
    expected, _ = brute(rows)
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.class_id == expected.get(r.doc_id) and r.kept == (r.doc_id is None or r.class_id == r.doc_id)
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_are_unbiased():
    draw = np.random.default_rng(1)
    shingle = draw.integers(1, 1 << 62, 40).astype(np.uint64)
    a, b = draw.integers(1, 12, 40), draw.integers(1, 12, 40)
    row = np.repeat([0, 1], 40)
    sig = near_duplicates.signatures(row, np.concatenate([shingle, shingle]), np.concatenate([a, b]), 2, 20_000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.015


def test_similarities():
    texts = ["a b c d e f g", "a b c d e f g h", "", "x", "a a a a a a a a", "a a a a a a a"]
    pairs = [(x, y) for x in texts for y in texts]
    got = near_duplicates.similarities(pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs]))
    assert np.allclose(got, [jaccard(bag(x), bag(y)) for x, y in pairs])


def test_links_between_members_that_are_no_ends(spark):
    """Variants of one text whose ends in every bucket are often too far from them, beside close copies of variants."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]

    def edited(words, n):
        words = list(words)
        for k in draw.sample(range(len(words)), n):
            words[k] = f"n{draw.random()}"
        return words

    far = [edited(base, 4 + k % 5) for k in range(150)]
    rows = list(enumerate(" ".join(w) for v in far for w in (v, edited(v, draw.randrange(1, 5)))))
    draw.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    expected, _ = brute(rows)
    assert 1 < len(set(expected.values())) < len(rows)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == expected


def test_exact_finish_finds_every_link_between_classes(spark):
    """Every link between different components, whatever the cells that a hot shingle is dealt over."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(5000)}" for _ in range(60)]
    rows = []
    for i in range(260):
        words = list(base)
        for k in draw.sample(range(60), 1 + i % 3):
            words[k] = f"n{draw.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(260, "a " * 50), (261, "a " * 55), (262, "a " * 80), (263, "x y"), (264, "x z"), (265, " ".join(base[:52]))]
    bags = {i: bag(t) for i, t in rows}
    part = {i: i if i % 3 else 0 for i in bags}
    expected = {(b, a) for a in bags for b in bags if a < b and part[a] != part[b] and jaccard(bags[a], bags[b]) >= 0.8}
    docs = spark.createDataFrame(rows, "id long, text string")
    crowd = spark.createDataFrame(list(part.items()), "id long, component long")
    for cell in (16, 4096):
        got = [(r.id, r.hub) for r in near_duplicates.bridges(crowd, docs, cell=cell).collect()]
        assert len(got) == len(set(got)) and len(expected) > 50 and expected <= set(got)
        assert all(part[a] != part[b] for a, b in got)


def test_an_id_with_two_texts(spark):
    """Every row gives one row, and a text without a duplicate stays though another text of its id goes."""
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (2, "another text that nothing else has"), (3, "zz yy"), (4, "seven words that only this row has"), (4, "one two three four five six"), (None, "zz yy"), (3, "zz yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates.near_duplicates(docs).collect()
    assert len(got) == len(rows) and sorted((r.class_id, r.kept) for r in got if r.doc_id == 2) == [(1, False), (2, True)]
    left = sorted(map(str, (tuple(r) for r in near_duplicates.without_duplicates(docs).collect())))
    assert left == sorted(map(str, [rows[0], rows[2], rows[3], rows[4], rows[6], rows[7]]))


def test_two_texts_of_one_id_alone(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (5, "h i j k l m n"), (6, "h i j k l m n")], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.kept) for r in near_duplicates.near_duplicates(docs).collect())
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False)]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, "g h", None, None)], "doc_id long, text string, _doc string, _h long")
    left = near_duplicates.without_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_a_large_bucket_meets_one_drawn_member_a_text(spark):
    spread = spark.createDataFrame([(i, i, b, 7000 + b) for i in range(300) for b in range(4)], "id long, doc long, band int, bucket long")
    labels = spark.createDataFrame([(i, 0) for i in range(100)], "node long, component long")
    pairs = [{(r.id, r.hub) for r in near_duplicates.drawn(spread, labels, turn).collect()} for turn in range(2)]
    assert all(0 < len(p) <= 300 and all(b < a and a >= 100 for a, b in p) for p in pairs) and pairs[0] != pairs[1]


def group(seed, n, words, edits):
    """Variants of one text that are like many others, but not all."""
    draw = random.Random(seed)
    base, rows = [f"w{k}" for k in range(words)], []
    for i in range(n):
        own = list(base)
        for k in draw.sample(range(words), draw.randrange(edits)):
            own[k] = f"n{draw.random()}"
        rows.append((i, " ".join(own)))
    return rows


def test_a_large_group_is_joined_by_a_forest(spark):
    """Check failure: pairs inside a large group of near copies became rows, by the square of its size."""
    rows = group(3, 500, 150, 5)
    docs = spark.createDataFrame(rows, "id long, text string")
    crowd = spark.createDataFrame([(i, i) for i, _ in rows], "id long, component long")
    known = near_duplicates._prefixes(near_duplicates._with_texts(crowd, docs).select("id", "component", "text"), 0.8)
    found = {flag: {(r.id, r.hub) for r in near_duplicates._bridges(known.coalesce(1), forest=flag).collect()} for flag in (True, False)}
    assert len(found[False]) > 50 * len(rows) > 0 and found[True] <= found[False]
    assert len(found[True]) < 5 * len(rows)
    links = spark.createDataFrame(sorted(found[True]), "a long, b long")
    assert {r.component for r in components.components(links).collect()} == {0}


def test_classes_are_joined_to_texts_not_to_their_buckets(spark):
    """Check failures: each text met its class once for every one of its 32 buckets, in each turn."""
    texts = spark.createDataFrame([(i, i, [7, 100 + i, 900 + i // 3]) for i in range(9)], "id long, doc long, bands array<long>")
    labels = spark.createDataFrame([(1, 0), (0, 0)], "node long, component long")
    assert {tuple(r) for r in near_duplicates.crowded(texts, labels).collect()} == {(i, 0 if i < 2 else i) for i in range(9)}
    assert near_duplicates.crowded(texts, texts.select(texts.id.alias("node"), (texts.id * 0).alias("component"))).isEmpty()


def test_merged_classes_are_those_of_all_links(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)]
    table = lambda rows: spark.createDataFrame([(max(p), min(p)) for p in rows if p[0] != p[1]], "a long, b long")
    got = components.merged(components.components(table(pairs[:35])), table(pairs[35:]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, components.components(table(pairs)).collect()))


def unlike(seed, n):
    """Variants of one text in eleven classes, those of different ones just not alike: 78 of 98 shingles."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"w{k}" for k in range(92)]
        own[5 + 8 * (i % 11) + draw.randrange(2)] = f"n{draw.random()}"
        rows.append((i, " ".join(own)))
    return rows


def test_a_pair_comes_from_few_cells(spark):
    """Check failure: texts that shared many prefix shingles gave their pair once for each of these."""
    rows = unlike(8, 200)
    known = near_duplicates._prefixes(spark.createDataFrame(rows, "id long, text string").selectExpr("id", "id AS component", "text"), 0.8).localCheckpoint()
    bags = {i: bag(t) for i, t in rows}
    alike = {(b, a) for a in bags for b in bags if a < b and jaccard(bags[a], bags[b]) >= 0.8}
    for cell in (16, 4096):
        got = [(r.id, r.hub) for r in near_duplicates._pairs(known, 0.8, cell, False).collect()]
        assert alike <= set(got) and len(got) < 1.5 * len(set(got))


def test_compared_pairs_stay_inside_tasks(spark):
    """Check failure: each pair that no bound ruled out was a row, by the square of a group's size."""
    rows = unlike(9, 300) + [(300, "a " * 50), (301, "a " * 55), (302, "x y"), (303, " ".join(f"z{k}" for k in range(40))), (304, " ".join(f"z{k}" for k in range(42)))]
    texts = spark.createDataFrame(rows, "id long, text string")
    known = near_duplicates._prefixes(texts.selectExpr("id", "id AS component", "text"), 0.8).localCheckpoint()
    pairs, bags = near_duplicates._bridges(known).count(), {i: bag(t) for i, t in rows}
    alike = [(a, b) for a in bags for b in bags if a < b and jaccard(bags[a], bags[b]) >= 0.8]
    classes = lambda links: sorted(map(tuple, components.components(spark.createDataFrame([(max(p), min(p)) for p in links], "a long, b long")).collect()))
    for cell, tokens in ((4096, 1 << 20), (16, 1 << 20), (4096, 400)):
        got = near_duplicates._joins(known, texts, 0.8, cell, tokens).collect()
        assert 0 < len(got) < (3 * len(rows) if cell * tokens == 1 << 32 else pairs) and 3 * len(rows) < pairs / 5
        assert all(r.id > r.hub and r.similarity == jaccard(bags[r.id], bags[r.hub]) >= 0.8 for r in got)
        assert classes((r.id, r.hub) for r in got) == classes(alike) and len({c for _, c in classes(alike)}) == 13


def test_measured_pairs_of_places():
    texts = ["a b c d e f g", "a b c d e f g h", "", "x", "a a a a a a a a", "a a a a a a a"]
    a, b = np.divmod(np.arange(36), 6)
    assert near_duplicates._measured(pa.chunked_array([texts[:2], texts[2:]]))(a, b).tolist() == [jaccard(bag(texts[x]), bag(texts[y])) for x, y in zip(a, b)]
