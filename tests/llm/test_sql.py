"""The exact operators' queries against their SQL in DuckDB."""

import duckdb
import pytest

from coordframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(tuple(r) for r in df.select(*rel.columns).collect())
    assert got == sorted(rel.fetchall())
