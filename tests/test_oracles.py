"""Every query of the library against its SQL on the small tables."""

import decimal

import duckdb
import pytest

from landlens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def cell(v):
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    queries, oracle = e.queries(), e.oracle_sql()
    assert set(oracle) <= set(queries) and set(QUERIES) <= set(queries)
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
