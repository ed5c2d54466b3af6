"""Nodes against a walk over all prefixes in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tests.llm.oracle import same
from threadlake.llm import prefix_tries, queries, sql

SF = "/root/testdata/sf0.001"


def walked(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        built = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        ends[built].append(c)
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((of[0], len(k), members[k[:-1]][0] if k else -1, len(of), children[k], leaves[k], saved[k], digest(ends[k])) for k, of in members.items())


def rows_of(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert rows_of(prefix_tries.prefix_trie(df)) == walked(rows)


def test_tables_and_sql(spark):
    same(queries.op11_prefix_trie(spark, SF), sql.PREFIX_TRIE, SF)


def test_random_conversations(spark):
    draw = random.Random(5)
    rows = [(c, t, "user", draw.choice(["a", "bb", "ccc"])) for c in draw.sample(range(700), 300) for t in range(draw.randint(1, 9))]
    check(spark, rows)


@pytest.mark.parametrize("slice_rows", [3, 1 << 15])
def test_long_conversation_over_all_partitions(spark, monkeypatch, slice_rows):
    """A third of all rows in one conversation, and a copy of it; every other one starts like it."""
    monkeypatch.setattr(prefix_tries, "_ROWS", slice_rows)
    long = [(t, "user", f"turn {t % 7}") for t in range(150)]
    rows = [(c, *x) for c in (100, 205) for x in long] + [(c, t, "user", f"turn {t % 7}") for c in range(101, 160) for t in range(c % 11 + 1)]
    check(spark, rows)


def test_blocks_of_running_sums_and_rounds_of_merges(spark, monkeypatch):
    monkeypatch.setattr(prefix_tries, "DEPTHS", 4)
    monkeypatch.setattr(prefix_tries, "FAN", 2)
    monkeypatch.setattr(prefix_tries, "RUN", 2)
    check(spark, [(c, t, "user", "same" if t < 20 else str(c)) for c in range(1, 30) for t in range(30)])


def test_nulls_ties_repeats_and_lost_leads(spark):
    rows = [(None, 0, "user", "x"), (7, None, "user", None), (7, 1, None, "y"), (7, 1, None, "y"), (8, None, None, None), (205, 0, "user", ""), (206, 3, "user", "z" * 100_000), (-3, 0, "user", "n")]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_tries.prefix_trie(empty).collect() == []
    rows = [(1, 0, "user", "a", 5, "b"), (2, 0, "user", "a", 6, "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long, part string")
    assert rows_of(prefix_tries.prefix_trie(df)) == walked([r[:4] for r in rows])
