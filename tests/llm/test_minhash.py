"""Near-duplicates against all pairs of full shingle sets."""

import random

import numpy as np
import pytest

from evidloom.llm import bytesops as bo
from evidloom.llm.components import components
from evidloom.llm.minhash import near_duplicates, superminhash


def shingles(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in lower).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_force(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i * 3 % (2 * n + 1), " ".join(t).upper() if i % 7 == 0 else "  ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 5)])
def test_against_all_pairs(spark, seed, size):
    rows = corpus(seed, 120) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "ONE")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=size, percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == brute_force(rows, size, 80)


def test_nulls_repeats_clashing_columns_and_empty(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", None), (None, "a b c d e f", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert out == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_string_ids_and_a_long_text(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60_000))
    rows = [("b", long), ("a", long + " tail"), ("é", "x y"), ("z", long[: len(long) // 3]), ("y", "x  Y")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {"a": "a", "b": "a", "z": "z" if shingle_share(rows[0][1], rows[3][1]) < 0.8 else "a", "é": "y", "y": "y"}


def shingle_share(a, b):
    x, y = shingles(a, 2), shingles(b, 2)
    return len(x & y) / len(x | y)


def test_groups_beside_a_centre(spark):
    """Two groups of near copies that share most, but too little, with each other, and one text between them."""
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(40):
        t = list(base)
        t[i] = f"own{i}"
        rows.append((i, " ".join(t)))
    for i in range(40):
        t = base[:80] + [f"other{k}" for k in range(20)]
        t[i] = f"mine{i}"
        rows.append((100 + i, " ".join(t)))
    for extra in ([], [(200, " ".join(base[:90] + [f"other{k}" for k in range(10, 20)]))]):
        df = spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(5)
        out = near_duplicates(df, size=1, percent=80).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == brute_force(rows + extra, 1, 80)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    h = bo.mix(rng.integers(0, 1 << 60, 300, dtype=np.uint64))
    a, b = h[:200], h[50:250]  # 150 of 250
    sig = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.06
    assert np.isinf(superminhash(h[:0], np.zeros(0, np.int64), 1, 8)).all()


def test_components_of_a_hot_node(spark):
    edges = [(5000, i) for i in range(10, 4000)] + [(3999, 7), (9000, 9001)]
    e = spark.createDataFrame(edges, "a long, b long").repartition(6)
    assert {r["node"]: r["component"] for r in components(e).collect()} == {**{i: 7 for i in range(10, 4000)}, 7: 7, 5000: 7, 9000: 9000, 9001: 9000}
    names = spark.createDataFrame([("é", "z"), ("z", "b"), ("c", "c")], "a string, b string")
    assert {r["node"]: r["component"] for r in components(names).collect()} == {"é": "b", "z": "b", "b": "b"}
    assert components(names.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (None, 3), (7, 7)], "a long, b long").repartition(7)
    assert {r["node"]: r["component"] for r in components(e).collect()} == {**{i: 0 for i in range(201)}, 499: 499, 500: 499}


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_one_id_join_what_is_near_any_of_them(spark, seed):
    rng = random.Random(seed)
    words = [f"x{k}" for k in range(500)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(4)]
    near = lambda t: " ".join([*t[:-1], rng.choice(words)])
    texts = [" ".join(b) for b in base]
    rows = [(1, texts[0]), (2, near(base[0])), (1, texts[1]), (3, near(base[1])), (9, texts[2]), (9, texts[3]), (9, near(base[0])), (7, near(base[2])), (8, near(base[3])), (5, near(base[3])), (20, "alone in the world here"), (20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(seed + 1)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df, size=2).collect()}
    assert got == {(i, 1, i == 1) for i in (1, 2, 3, 5, 7, 8, 9)} | {(20, 20, True)}
