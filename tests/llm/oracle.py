"""Runs a query and its SQL twin over the same tables and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    return sorted(rel.columns), sorted((tuple(map(repr, (v for _, v in sorted(zip(rel.columns, r))))) for r in rel.fetchall()))


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(repr(r[c]) for c in names) for r in df.collect())


def same(df, sql, sf_dir):
    (a, x), (b, y) = spark_rows(df), sql_rows(sql, sf_dir)
    assert a == b, (a, b)
    assert len(x) == len(y), (len(x), len(y))
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    assert not bad, (len(bad), bad[:5])
