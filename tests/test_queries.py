"""Every registered query with SQL against DuckDB, as the driver compares them."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from coordframe import queries as tensor_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    return "nan" if math.isnan(v) else round(v, 6) + 0.0


@pytest.mark.parametrize("name", sorted(tensor_queries.ORACLES))
def test_sql(name, spark, sf_dir, duck):
    df = entry.queries()[name](spark, sf_dir)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    at = [rel.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want


def test_every_query_has_sql():
    assert set(tensor_queries.QUERIES) == set(tensor_queries.ORACLES)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
