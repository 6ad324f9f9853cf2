"""Trees grown by levels against a recursive search over all cuts, and on held-out rows."""

import math
import random
from collections import Counter

from evidloom.operators.trees import fit_tree, predicted


def entropy(ys):
    return -sum(c * math.log2(c / len(ys)) for c in Counter(ys).values()) if ys else 0.0


def value(x):
    return -math.inf if x is None else math.inf if x != x else x


def grow(rows, depth, least, node, out):
    """out: node -> (feature, threshold) or label, by trying every value as a cut."""
    ys = [r[-1] for r in rows]
    best = (0.0,)
    if depth:
        for f in range(len(rows[0]) - 1):
            for t in sorted({value(r[f]) for r in rows} - {-math.inf, math.inf}):
                low, high = [r[-1] for r in rows if value(r[f]) <= t], [r[-1] for r in rows if value(r[f]) > t]
                if min(len(low), len(high)) >= least:
                    gain = round((entropy(ys) - entropy(low) - entropy(high)) / len(ys), 12)
                    if gain > best[0]:
                        best = (gain, f, t)
    out[node] = min(Counter(ys).items(), key=lambda x: (-x[1], x[0]))[0] if len(best) == 1 else best[1:]
    if len(best) > 1:
        _, f, t = best
        grow([r for r in rows if value(r[f]) <= t], depth - 1, least, 2 * node, out)
        grow([r for r in rows if value(r[f]) > t], depth - 1, least, 2 * node + 1, out)


def walk(tree, row):
    node = 1
    while isinstance(tree[node], tuple):
        f, t = tree[node]
        node = 2 * node + (value(row[f]) > t)
    return tree[node]


def data(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = rng.randrange(12) / 4, rng.choice([None, float("nan"), *range(6)])
        y = int(a > 1.5) + int(value(b) > 2) if rng.random() < 0.85 else rng.randrange(3)
        rows.append((a, b if b is None else float(b), y))
    return rows


SCHEMA = "a double, b double, y int"


def test_equals_a_recursive_search(spark):
    rows = data(500, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    for depth, least in ((0, 1), (1, 5), (4, 20), (10, 7)):
        want: dict = {}
        grow(rows, depth, least, 1, want)
        tree = fit_tree(df, ["a", "b"], "y", depth, least)
        # Cuts between the same values are the same cut.
        got = [r["p"] for r in predicted(tree, df.coalesce(1), "p", "int").collect()]
        assert got == [walk(want, r) for r in rows]
        assert len(tree.splits) == sum(isinstance(v, tuple) for v in want.values())


def test_held_out_rows_and_quantile_bins(spark):
    rng = random.Random(3)
    rows = [(x := rng.random(), y := rng.random(), int((x > 0.3) != (y > 0.6)) if rng.random() < 0.95 else rng.randrange(2)) for _ in range(6000)]
    train, rest = spark.createDataFrame(rows[:4000], SCHEMA), spark.createDataFrame(rows[4000:], SCHEMA)
    tree = fit_tree(train, ["a", "b"], "y", depth=10, least=50, bins=32)
    found = predicted(tree, rest, "p", "int")
    assert found.where("p = y").count() >= 0.9 * rest.count()
    leaves = Counter(walk(tree.splits | {n: n for n in tree.labels if n not in tree.splits}, r) for r in rows[:4000])
    assert min(leaves.values()) >= 50 and max(tree.splits) < 2**10


def test_empty_null_labels_and_one_class(spark):
    none = spark.createDataFrame([(1.0, 2.0, None)], SCHEMA)
    assert predicted(fit_tree(none, ["a", "b"], "y"), none, "p", "int").first()["p"] is None
    one = spark.createDataFrame([(float(i), None, 2) for i in range(9)] + [(1.0, 1.0, None)], SCHEMA)
    tree = fit_tree(one, ["a", "b"], "y", least=1)
    assert not tree.splits and {r["p"] for r in predicted(tree, one, "p", "int").collect()} == {2}
