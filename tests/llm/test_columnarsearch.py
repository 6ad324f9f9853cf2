"""Exact top-k search against all products, and its edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidloom.llm import columnarsearch as C

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k, scale=256):
    """Answers by all products of the rows' whole components; an id's own rows are none of its candidates."""
    whole = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows]
    out = []
    for i, q in {(i, tuple(v)) for i, v in whole if i % 5 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i and len(v) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def answers(spark, rows, k=3):
    return sorted(tuple(r) for r in C.top_k(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 5 == 0, k).collect())


def test_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(C, "SEEDS", 8)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(20) * rng.choice([0.1, 1, 3], 20)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(9)]  # copies, and so ties
    assert answers(spark, rows) == brute(rows, 3)


def test_edges(spark):
    good = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (5, [0.5]), (6, [2.0]), (10, []), (11, []), (15, [1.0, 2.0, 3.0])]
    bad = [(2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (20, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    assert answers(spark, good + bad) == brute(good, 3)
    assert answers(spark, []) == [] and answers(spark, [(0, [1.0])]) == []


def test_one_id_with_two_vectors_is_ranked_for_each_and_repeats_are_asked_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert answers(spark, rows, k=1) == [(0, 1, 1, 65536), (0, 1, 2, 65536)]


def test_large_components_are_cut(spark):
    got = answers(spark, [(0, [1e30, 1.0]), (1, [-1e30, 2.0])], k=1)
    assert got == [(0, 1, 1, -(C.LARGEST**2) + 256 * 512)]


@pytest.mark.parametrize("high", [50, 1 << 22])
def test_survivors_lose_no_pair(high):
    rng = np.random.default_rng(high)
    q, c = rng.integers(-high, high, (30, 40)), rng.integers(-high, high, (30, 300)) // rng.integers(1, 20, 300)
    floor = np.sort(q.T @ c, axis=1)[:, -7]
    a, b, score = C.survivors(q, c, C.rests(q), C.rests(c), floor)
    want = {(i, j): s for i, row in enumerate((q.T @ c).tolist()) for j, s in enumerate(row) if s >= floor[i]}
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), score.tolist(), strict=True)) == want
