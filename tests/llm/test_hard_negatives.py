"""Hard negatives against all inner products."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.oracle import same
from threadlake.llm import hard_negatives, queries, sql

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def brute(rows, every):
    items = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, v in items:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in items))
        near = [(s, j) for s, j, m in scored if m == l and j != i][:5]
        for s, j in near:
            hard = [(t, k) for t, k, m in scored if m != l and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(hard, 1)]
    return sorted(out)


def check(spark, rows, every=5):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    items = hard_negatives.whole_vectors(df, "vec_id", "label", "embedding")
    got = sorted(tuple(r) for r in hard_negatives.mined(items, F.col("id") % every == 0).collect())
    assert got == brute(rows, every)
    return got


def test_tables_and_sql(spark):
    same(queries.op13_hard_negatives(spark, SF), sql.HARD_NEGATIVES, SF)


@pytest.mark.parametrize("block, slice_rows, cell_rows", [(16_384, 2048, 1 << 18), (7, 10, 20)])
def test_clusters_ties_and_one_hot_vector(spark, monkeypatch, block, slice_rows, cell_rows):
    """A third of all rows are one vector; small blocks, slices and parts of cells give the same."""
    for name, value in (("BLOCK", block), ("SLICE", slice_rows), ("CELL_ROWS", cell_rows)):
        monkeypatch.setattr(hard_negatives, name, value)
    draw = random.Random(4)
    middles = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, draw.randrange(3), [1.0, 0.5, -0.25, 0.0, 2.0, 1.0] if i % 3 == 0 else [x + draw.gauss(0, 0.3) for x in draw.choice(middles)]) for i in range(300)]
    assert check(spark, rows)


def test_odd_rows(spark):
    rows = [(5, 1, [1.0, 2.0]), (6, 1, [1.0, 1.9]), (7, 2, [1.0, 1.2]), (8, 2, [0.5, 1.0, 0.0]), (9, 3, [1.0]), (10, 1, []), (15, None, [1.0, 1.0]), (20, 1, None), (25, 1, [NAN, 1.0]), (30, 1, [INF, 1.0]), (35, 2, [None, 1.0]), (None, 1, [1.0, 1.0]), (5, 1, [1.0, 2.0]), (40, 9, [0.0, 0.0]), (45, 2, [-1.0, -2.0])]
    check(spark, rows)


def test_empty_and_huge(spark):
    assert check(spark, []) == []
    assert check(spark, [(5, None, [1.0])]) == []
    df = spark.createDataFrame([(5, 1, [1e30, 1.0], "x"), (6, 1, [-1e30, 1.0], "y"), (7, 2, [1e30, 0.0], "z")], "vec_id long, label int, embedding array<float>, score string")
    items = hard_negatives.whole_vectors(df, "vec_id", "label", "embedding")
    assert items.agg(F.max(F.array_max("v"))).first()[0] == 1 << 24
    assert hard_negatives.mined(items, F.col("id") % 5 == 0).count() == 0
