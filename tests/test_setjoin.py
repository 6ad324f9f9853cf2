"""Windowed best ratio against all windows; similarity join of sets against all pairs, on random, skewed and repeated sets, and how many pairs the filters leave."""

import random

import pytest
from pyspark.sql import functions as F

from evidloom.operators import setjoin as J

SCHEMA = "id long, items array<string>, often int, rep string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)


def sets(rng, n, vocabulary, hot):
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, 25))] for _ in range(n // 3 + 1)]
    out = []
    for i in range(n):
        v = list(rng.choice(base)) + [f"hot{k}" for k in range(hot)]
        for _ in range(rng.choice([0, 1, 2, 6])):
            v[rng.randrange(len(v))] = f"w{rng.randrange(vocabulary)}"
        out.append((i, v))
    return out


def brute(left, right, percent):
    def first_of(rows):
        out = {}
        for i, v in sorted((i, frozenset(x for x in v or () if x is not None)) for i, v in rows if i is not None):
            if v:
                out.setdefault(v, i)
        return [(i, v) for v, i in out.items()]

    one, two = first_of(left), first_of(left if right is None else right)
    return sorted((i, j, len(v), len(w), len(v & w)) for i, v in one for j, w in two if (right is not None or i < j) and 100 * len(v & w) >= percent * len(v | w))


@pytest.mark.parametrize(("percent", "vocabulary", "hot"), [(50, 60, 0), (80, 60, 3), (34, 400, 2), (100, 30, 0), (7, 300, 0)])
def test_equals_all_pairs(spark, percent, vocabulary, hot):
    rng = random.Random(percent)
    left, right = sets(rng, 90, vocabulary, hot), sets(rng, 60, vocabulary, hot)
    got = J.similar_sets(frame(spark, left), None, "id", "items", percent)
    assert sorted(map(tuple, got.collect())) == brute(left, None, percent)
    got = J.similar_sets(frame(spark, left), frame(spark, right).withColumnsRenamed({"id": "k", "items": "v"}), "id", "items", percent, "k", "v")
    assert sorted(map(tuple, got.collect())) == brute(left, right, percent)


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [None]), (4, ["a", "a", None, "b"]), (5, ["b", "a"]), (6, ["a", "b", "c"]), (None, ["a", "b"]), (7, ["z"]), (6, ["a", "b", "c"])]
    assert sorted(map(tuple, J.similar_sets(frame(spark, rows), None, "id", "items", 60).collect())) == [(4, 6, 2, 3, 2)]
    assert sorted((r["id"], r["rep"]) for r in J.set_classes(frame(spark, rows), "id", "items").collect()) == [(4, 4), (5, 4), (6, 6), (6, 6), (7, 7)]
    assert J.similar_sets(frame(spark, []), None, "id", "items", 60).count() == 0
    with pytest.raises(ValueError, match="percent"):
        J.similar_sets(frame(spark, []), None, "id", "items", 0)


def test_candidates_grow_with_the_input_and_not_with_its_square(spark):
    """Every set holds ten hot items; a filter that let them meet would leave all pairs."""

    def left(n):
        rng = random.Random(n)
        rows = [(i, [f"hot{k}" for k in range(10)] + [f"w{rng.randrange(40 * n)}" for _ in range(30)]) for i in range(n)]
        one = J._distinct_sets(frame(spark, rows), "id", "items")
        often = one.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("often"))
        ordered = J._ordered(one, often)
        return J.candidates(ordered, ordered, 70, True).count()

    small, large = left(300), left(3000)
    assert large <= 15 * max(small, 20) and large < 3000


def test_pairs_that_share_prefixes_leave_where_they_meet(spark):
    """Few items, so that nearly all pairs share one of their rarest; the sketches leave those alone that are similar."""
    rng = random.Random(3)
    rows = [(i, [f"w{x}" for x in rng.sample(range(100), 30)]) for i in range(300)]
    rows += [(1000 + i, [*v[:-2], "x"]) for i, v in rows[:20]]
    one = J._distinct_sets(frame(spark, rows), "id", "items")
    often = one.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("often"))
    ordered = J._ordered(one, often)
    found = {(r["a"], r["b"]) for r in J.candidates(ordered, ordered, 60, True).collect()}
    right = {x[:2] for x in brute(rows, None, 60)}
    assert len(right) >= 20 and right <= found and len(found) <= 10 * len(right)


def all_windows(query, text):
    import difflib

    if not query or not text:
        return 0.0, 0, 0
    ratio = lambda w: difflib.SequenceMatcher(None, w, query, autojunk=False).ratio()
    if len(text) <= len(query):
        return ratio(text), 0, len(text)
    lengths = {max(1, len(query) - 1), len(query), min(len(text), len(query) + 1)}
    best = max((ratio(text[s : s + n]), -s, -n) for n in lengths for s in range(len(text) - n + 1))
    return best[0], -best[1], -best[2]


def test_best_window_is_that_of_all_windows(spark, monkeypatch):
    import difflib

    from evidloom.operators import texts as X

    rng = random.Random(8)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    pairs = [(i, word(9, k), word(60, k)) for i, k in enumerate(["ab", "abcde", "abcdefghijklmnop"] * 60)]
    pairs += [(1000, "열이 나요", "어제부터 열이 좀 나요 그리고"), (1001, None, "x"), (1002, "x", None), (1003, pairs[1][1], pairs[1][2])]
    got = X.windowed_ratio(spark.createDataFrame(pairs, "id int, q string, t string"), "q", "t").collect()
    assert {r["id"]: (r["ratio"], r["start"], r["length"]) for r in got} == {i: all_windows(q, t) if q is not None and t is not None else (None,) * 3 for i, q, t in pairs}
    calls = []
    real = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or real(self))
    assert X.best_window("headache", "z" * 500 + "headache" + "y" * 500)[:2] == (1.0, 500)
    assert len(calls) <= 3
