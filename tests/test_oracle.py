"""Every query with SQL is held against it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from terrafold.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def value(v):
    return v if v is None or isinstance(v, bool | str) else round(float(v), 6) + 0.0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLE_SQL[name])
    theirs = [c[0] for c in cur.description]
    assert sorted(theirs) == cols
    key = lambda row: [str(x) for x in row]
    got = sorted(([value(r[c]) for c in cols] for r in df.collect()), key=key)
    want = sorted(([value(r[theirs.index(c)]) for c in cols] for r in cur.fetchall()), key=key)
    assert got == want and got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
