"""Every query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert cols == sorted(names)
    want = sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted(tuple(plain(x[c]) for c in cols) for x in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 3
