"""Greedy spans by pointer doubling against a loop over each key."""

import random

from evidloom.operators.spans import greedy_spans


def loop(rows):
    out, last = set(), {}
    for k, a, b in sorted({r for r in rows if None not in r and r[2] > r[1]}, key=lambda r: (str(r[0]), r[1], -r[2])):
        if k not in last or last[k] <= a:
            out.add((k, a, b))
            last[k] = b
    return out


def chosen(spark, rows, width, kind="k string, s long, e long"):
    df = spark.createDataFrame(rows, kind).selectExpr("*", "0 as a", "1 as next")
    return [tuple(r) for r in greedy_spans(df, ["k"], "s", "e", width).collect()]


def test_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abcd"), a := rng.randrange(600), a + rng.choice([1, 2, 3, 9, 200])) for _ in range(900)]
    rows += [("x", 5, 5), ("x", 9, 3), ("y", None, 4), ("y", 1, None), (None, 1, 2), ("z", -7, -2), ("z", -2, 4), ("z", -7, -5), ("z", -5, -2)] + rows[:20]
    for width in (1, 16, 10_000):
        got = chosen(spark, rows, width)
        assert len(got) == len(set(got)) and set(got) == loop(rows)


def test_a_long_chain_takes_few_rounds(spark):
    rows = [("k", i, i + 1) for i in range(300)]
    assert sorted(chosen(spark, rows, 50)) == rows


def test_empty_and_only_unusable(spark):
    assert chosen(spark, [], 8) == [] and chosen(spark, [("k", 3, 3), (None, 1, 4)], 8) == []


def test_times_as_fractions(spark):
    assert sorted(chosen(spark, [("k", 0.0, 0.5), ("k", 0.5, 0.75), ("k", 0.6, 3.0)], 0.25, "k string, s double, e double")) == [("k", 0.0, 0.5), ("k", 0.5, 0.75)]
