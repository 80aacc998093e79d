"""Every relational query against its SQL, run by DuckDB on the same files."""

import datetime
import decimal
import math

import duckdb
import pytest

from marlspike import catalog

SF = "/root/testdata/sf0.001"
#: One local day out of seven years: without messages in the smallest tables.
EMPTY_WHEN_SMALL = ("a13_quota",)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    wanted = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    got = rows_of(found.columns, found.collect())
    assert got == rows_of(names, wanted.fetchall())
    assert got or name in EMPTY_WHEN_SMALL


def test_every_query_without_sql_is_known():
    """Queries without SQL have tests of their own (brute force or golden vectors)."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(catalog.TESTED_BY_VECTORS)
