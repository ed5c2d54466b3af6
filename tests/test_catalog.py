import datetime
import math

import duckdb
import pytest
from threadlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = "/root/testdata/sf0.001"


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return repr(x)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, con, name):
    df, rel = catalog.QUERIES[name](spark, D), con.sql(catalog.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    want = sorted(tuple(cell(dict(zip(rel.columns, r))[c]) for c in names) for r in rel.fetchall())
    assert got == want, (len(got), len(want), [x for x in zip(got, want) if x[0] != x[1]][:3])
