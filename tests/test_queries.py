"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from evidloom import registry

registry.load()
DATA = os.environ.get("EVIDLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(registry.ORACLE[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_bootstrap_covers_the_mean(spark):
    from pyspark.sql import functions as F

    mean = spark.read.parquet(f"{DATA}/orders.parquet").agg(F.avg("o_totalprice")).first()[0]
    lo, hi, n = registry.QUERIES["A28_clustered_bootstrap"](spark, DATA).select("lo", "hi", "replicates").first()
    assert n == 200 and lo < mean < hi and hi - lo < 0.5 * mean


def test_step_loop_asks_two_different_questions(spark):
    rows = registry.QUERIES["I3_batch_step_loop"](spark, DATA).collect()
    assert all(r["first"] != r["second"] for r in rows) and len({r["first"] for r in rows}) == 1


def test_matching_ratio_is_difflibs(spark):
    import difflib

    for r in registry.QUERIES["F23_matching_ratio"](spark, DATA).limit(50).collect():
        assert r["ratio"] == difflib.SequenceMatcher(None, r["a"], r["b"], autojunk=False).ratio()
