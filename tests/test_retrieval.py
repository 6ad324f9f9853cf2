"""Preselection by shared words against all pairs, with and without hot words; the second ranking against a loop."""

import math
import random
from collections import Counter

from evidloom.operators import retrieval as R
from pyspark.sql import functions as F


def overlaps(queries, rows, k, same):
    out = set()
    for q, a in queries:
        a = Counter((a or "").split())
        n = [(-sum(a[t] * c for t, c in Counter((b or "").split()).items()), i) for i, b in rows if i is not None and not (same and i == q)]
        out |= {(q, i, -m) for m, i in sorted(x for x in n if x[0])[:k]}
    return out


def found(spark, queries, rows, k, hot, same=False):
    q, d = spark.createDataFrame(queries, "q long, s string"), spark.createDataFrame(rows, "i long, s string")
    words = F.split("s", " ")
    return {tuple(r) for r in R.most_shared(R.postings(q, "q", words, "query_id"), R.postings(d, "i", words, "id"), k, hot, same).collect()}


def test_equals_all_pairs_at_every_bound(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the"] * 30 + ["of"] * 20 + ["in"] * 10 + [f"w{j}" for j in range(40)])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(9)))) for i in range(150)] + [(i, "the of in") for i in range(150, 200)] + [(200, None), (201, ""), (None, "the of"), (202, "  the   w1")]
    queries = rows[::7] + [(500, "nowhere"), (501, None), (502, "the")]
    queries = [r for r in queries if r[0] is not None]
    for k, hot, same in ((5, 4, True), (5, 20, False), (20, 1000, True), (1, 0, True)):
        assert found(spark, queries, rows, k, hot, same) == overlaps(queries, rows, k, same)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 3, 1) == set() and found(spark, [(1, "a")], [], 3, 1) == set()


def test_rerank_equals_a_loop(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 6)))) for i in range(60)] + [(60, ""), (61, None), (62, "a")]
    queries = [(i, s) for i, s in rows[::5]] + [(99, None), (98, "zz zz")]
    grams = lambda s: Counter(f" {s} "[i : i + 3] for i in range(len(s))) if s is not None else Counter()
    df = Counter(g for _, s in rows for g in grams(s))
    idf = {g: math.log((1 + len(rows)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(s):
        v = {g: c * idf[g] for g, c in grams(s).items() if g in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    first, want = overlaps(queries, rows, 12, False), set()
    text, ask = dict(rows), dict(queries)
    for q in ask:
        each = [(-round(sum(w * vector(text[i]).get(g, 0) for g, w in vector(ask[q]).items()), 6), -n, i) for p, i, n in first if p == q]
        want |= {(q, i, -n, -c) for c, n, i in sorted(each)[:4]}
    q, d = spark.createDataFrame(queries, "q long, s string").withColumn("n", F.lit(1)), spark.createDataFrame(rows, "i long, s string").withColumn("t", F.lit("x"))
    got = {tuple(r) for r in R.preselect_and_rerank(q, d, "q", "s", "i", "s", select=12, k=4, hot=10).collect()}
    assert got == want


def test_no_pair_is_written_and_blocks_change_nothing(spark, monkeypatch):
    """Every query shares a word with every row; only texts, counts and the best of a block may move."""
    written = []
    whole = R.cut
    monkeypatch.setattr(R, "cut", lambda df: written.append(df.count()) or whole(df))
    rows = spark.range(400).selectExpr("concat(id, ' the w', id % 7) AS s")
    queries = spark.range(100).selectExpr("id AS q", "concat('the ', id % 9, ' w', id % 5) AS s")
    best = lambda hot: {tuple(r) for r in R.preselect_and_rerank(queries, rows, "q", "s", "s", "s", select=300, k=5, hot=hot).collect()}
    want = best(4_000)
    assert len(want) == 500 and max(written) < 10_000
    monkeypatch.setattr(R, "GROUP", 30)
    monkeypatch.setattr(R, "BLOCK_BITS", 3)
    assert best(2) == want
