"""Every query of the engine against its SQL, on the driver's smallest tables."""

import decimal
import os

import duckdb
import pytest

from annalist.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations orders".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return int(v) if isinstance(v, decimal.Decimal) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = con.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
