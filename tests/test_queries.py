"""Every query with SQL gives the SQL's rows over the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera import queries

NAMES = sorted(queries.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(found):
    return sorted(tuple(repr(x + 0.0) if isinstance(x, float) else repr(x) for x in r) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf, con, name):
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.fetchall())
    spark.catalog.clearCache()


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(queries.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
