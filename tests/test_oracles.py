"""Every registered query with SQL against DuckDB on the smallest driver tables."""

import os

import duckdb
import pytest

from rasterloom.plans.oracles import SQL as FIRST_SQL
from rasterloom.plans.queries import QUERIES as FIRST
from rasterloom.plans.row_oracles import ROW_SQL
from rasterloom.plans.row_queries import ROW_QUERIES
from rasterloom.plans.search_queries import QUERIES as SEARCHES
from rasterloom.plans.search_queries import SQL as SEARCH_SQL

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = [*FIRST, *ROW_QUERIES, *SEARCHES], FIRST_SQL | ROW_SQL | SEARCH_SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
BY_NAME = {f.__name__: f for f in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(BY_NAME) and len(BY_NAME) == len(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same(BY_NAME[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(BY_NAME) - set(SQL)))
def test_other_queries_run(spark, name):
    assert BY_NAME[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
