"""Each registered query of the core engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from looploom.plans import registry
from verify import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in registry.ORACLE_SQL:
        rel = con.sql(registry.ORACLE_SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert got == rows(rel.columns, rel.fetchall())


def test_entry_names():
    import __spark_entry__ as e

    q = e.queries()
    assert set(e.oracle_sql()) <= set(q)
    assert set(registry.QUERIES) <= set(q)
