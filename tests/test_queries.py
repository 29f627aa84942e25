"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from tickloom.plans.queries import ORACLE, QUERIES
from tools.compare import TABLES, plain


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, tables, name):
    got, want = plain(QUERIES[name](spark, sf).toPandas()), plain(tables.execute(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
