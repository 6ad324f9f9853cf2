"""Periodic runs against a search of all periods, planted tails and edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from evidloom.llm import periodicruns as P
from evidloom.llm import queries

SCHEMA = "doc_id long, text string, runs int, n_words int"


def brute(w, min_length=12):
    """All (start, length, period): for each period from 1 on, maximal stretches of agreement with the word a period later."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rng):
    n, k = rng.choice([0, 1, 11, 12, 13, 24, 60]), rng.choice([1, 2, 2, 3, 30])
    w = [str(rng.randrange(k)) for _ in range(n)]
    if n > 12 and rng.random() < 0.7:
        a = rng.randrange(n - 1)
        p = rng.randrange(1, max(2, (n - a) // 2))
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("min_length", [12, 7])
def test_equals_a_search_of_all_periods(spark, min_length):
    rng = random.Random(min_length)
    texts = [random_words(rng) for _ in range(600)]
    df = spark.createDataFrame([(i, "\t ".join(w), 0, 0) for i, w in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in P.periodic_runs(df, min_length).collect()}
    for i, w in enumerate(texts):
        want = brute(w, min_length)
        assert [tuple(x) for x in got[i]["runs"]] == want
        assert got[i]["n_words"] == len(w) and got[i]["collapsed"] == collapsed(w, want)


def test_edges(spark):
    long = " ".join(f"w{i % 7919}" for i in range(120_000))  # over 2 MB would be a chunk of its own; this is one run
    rows = [(1, None, 0, 0), (2, "", 0, 0), (3, " \n", 0, 0), (4, "é " * 12, 0, 0), (4, "é " * 12, 0, 0), (None, "a b " * 6, 0, 0), (5, long, 0, 0), (6, "x\x0by z " * 6, 0, 0)]
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"] if r["doc_id"] != 5 else "") for r in P.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 12, [(0, 12, 1)], "é"), ("4", 12, [(0, 12, 1)], "é"), ("5", 120_000, [(0, 120_000, 7919)], ""), ("6", 12, [(0, 12, 2)], "x y z"), ("None", 12, [(0, 12, 2)], "a b")]
    assert P.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_text_of_megabytes_among_others(spark):
    rng = random.Random(1)
    w = [f"{rng.random()}" for _ in range(150_000)]
    w[90_000:140_000] = [w[90_000 + i % 20_000] for i in range(50_000)]
    df = spark.createDataFrame([(0, "a " * 20, 0, 0), (1, " ".join(w), 0, 0), (2, "b " * 20, 0, 0)], SCHEMA)
    assert [[tuple(x) for x in r["runs"]] for r in P.periodic_runs(df).orderBy("doc_id").collect()] == [[(0, 20, 1)], [(90_000, 50_000, 20_000)], [(0, 20, 1)]]


def test_longest_run_breaks_ties_by_start(spark):
    df = spark.createDataFrame([([(5, 12, 1), (40, 14, 2), (60, 14, 1)],), ([],)], "runs array<struct<start: long, length: long, period: long>>")
    assert [r[0] and tuple(r[0]) for r in df.select(P.longest_run(F.col("runs"))).collect()] == [(40, 14, 2), None]


def test_query_is_the_contract(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(random_words(rng)) if i % 9 else None) for i in range(400)] + [(None, "a " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def want(i, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = brute(w)
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(collapsed(w, runs)))

    got = sorted((tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((want(*r) for r in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and r for i, r in rows[:400])
