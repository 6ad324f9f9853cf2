"""Queries of this subpackage that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from evidloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE[name])
    names = [x[0] for x in found.description]
    want = sorted(str([dict(zip(names, r, strict=True))[c] for c in columns]) for r in found.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want
