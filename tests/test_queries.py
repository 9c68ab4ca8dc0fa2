"""Every registered query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tidemark import catalog

D = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, D)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    sql = db.sql(catalog.oracle_sql()[name])
    assert sorted(sql.columns) == names
    at = [sql.columns.index(c) for c in names]
    want = sorted((tuple(r[k] for k in at) for r in sql.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_without_the_optional_subpackage():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
