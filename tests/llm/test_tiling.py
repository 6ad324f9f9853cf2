"""Greedy string tiling and decontamination against tiling of whole texts without seeds."""

import random
import time

import pytest

from evidloom.llm.tiling import decontaminate, greedy_tiles


def naive_tiles(item, text, least):
    """One length at a time from the longest down; of a length, the first free place in the item, then in the text."""
    free_i, free_t, tiles = [True] * len(item), [True] * len(text), []
    for n in range(min(len(item), len(text)), least - 1, -1):
        for a in range(len(item) - n + 1):
            for b in range(len(text) - n + 1):
                if item[a : a + n] == text[b : b + n] and all(free_i[a : a + n]) and all(free_t[b : b + n]):
                    tiles.append((a, b, n))
                    free_i[a : a + n] = free_t[b : b + n] = [False] * n
                    break
    return tiles


@pytest.mark.parametrize("seed", range(40))
def test_tiles_against_a_search_of_all_places(seed):
    rng = random.Random(seed)
    letters = rng.choice([1, 2, 3, 8])
    item, text = ([rng.randrange(letters) for _ in range(rng.randint(0, 24))] for _ in range(2))
    if seed % 3 == 0:
        text = text + [-1] + item[::-1] + item[3:12] + item[:5]
    for least in (1, 2, 4):
        assert greedy_tiles(item, text, least) == naive_tiles(item, text, least)


def test_long_pairs_are_quick():
    rng = random.Random(1)
    base = [rng.randrange(300) for _ in range(2000)]
    pieces = [base[k : k + 37] for k in range(0, 2000, 37)]
    rng.shuffle(pieces)
    text = [w for p in pieces for w in (*p, *(rng.randrange(300) for _ in range(35)))]
    begin = time.perf_counter()
    assert sum(n for _, _, n in greedy_tiles(base, text, 5)) > 1900
    assert sum(n for _, _, n in greedy_tiles([7] * 2000, [7] * 4000, 5)) == 2000
    assert time.perf_counter() - begin < 5  # well under a second each on a quiet machine


def test_longest_tiles_first():
    item, text = list(range(20)), [*range(10, 20), 99, *range(10)]
    assert greedy_tiles(item, text, 5) == [(0, 11, 10), (10, 0, 10)]
    assert greedy_tiles([1, 1, 1, 1], [1, 1, 1, 1, 1, 1], 2) == [(0, 0, 4)]
    assert greedy_tiles([], [1], 1) == []


NUMBERS: dict[str, int] = {}


def rolled(text):
    """A number for each word."""
    return [NUMBERS.setdefault(w, len(NUMBERS)) for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()]


def brute_force(docs, items, least, coverage, tiles=naive_tiles):
    """Leaked items of each document, tiled on the whole text."""
    out = {}
    for i, t in docs:
        words = rolled(t)
        for k, b in items:
            item = rolled(b)
            if item and sum(n for _, _, n in tiles(item, words, min(least, len(item)))) >= coverage * len(item):
                out.setdefault(i, set()).add(k)
    return {i: len(v) for i, v in out.items()}


def test_against_whole_texts(spark):
    rng = random.Random(5)
    words = [f"t{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for k in range(30)] + [(98, None), (99, "")]
    docs = []
    for i in range(80):
        parts = [[rng.choice(words) for _ in range(rng.randint(0, 50))]]
        if i % 3 == 0:
            leak = rng.choice(items[:30])[1].split()
            cut = rng.randrange(len(leak) + 1)
            parts += [leak[cut:], [rng.choice(words)], leak[:cut]] if i % 2 else [leak]
        rng.shuffle(parts)
        docs.append((i, " ".join(w for p in parts for w in p).upper() if i % 5 == 0 else "\n".join(w for p in parts for w in p)))
    docs += [(500, None), (501, "")]
    want = brute_force(docs, items, 5, 0.8)
    assert want  # something leaks
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (1_000_000, 0):  # the seed table sent to the tasks, and joined
        from evidloom.llm import tiling

        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        pairs = tiling.tiled_pairs(df, bench, 5, seed_rows=bound).where("n_covered >= 0.8 * n_item").groupBy("doc_id").count().collect()
        assert {r["doc_id"]: r["count"] for r in pairs} == want
    out = {r["doc_id"]: r for r in decontaminate(df, bench).collect()}
    assert len(out) == len(docs) and {i for i, r in out.items() if r["contaminated"]} == set(want)


def test_stock_phrases_pair_nothing(spark):
    """Every document and item holds one phrase; only leaked items are tiled, with ids of any type."""
    from evidloom.llm import tiling

    stock = "which of the following statements is true"
    items = [(f"i{k}", f"{stock} " + " ".join(f"q{k}w{j}" for j in range(20))) for k in range(20)]
    docs = [(f"d{k}", f"{stock} " + " ".join(f"x{k}y{j}" for j in range(30))) for k in range(50)] + [("leak", items[3][1] + " x y z"), ("long", "pad " * 50_000 + items[5][1])]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id string, text string, item_id string, n int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in tiling.tiled_pairs(df, bench, 5, 0.8).collect()} == {("leak", "i3"), ("long", "i5")}
    out = {r["doc_id"]: r["item_id"] for r in decontaminate(df, bench).where("contaminated").collect()}
    assert out == {"leak": "i3", "long": "i5"}


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, None), (2, "a b c d e f"), (2, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    out = sorted(((r["doc_id"], r["contaminated"]) for r in decontaminate(docs, bench).collect()), key=str)
    assert out == [(1, False), (2, True), (2, True), (None, False)]
    assert [r["contaminated"] for r in decontaminate(docs, bench.limit(0)).collect()] == [False] * 4
    assert decontaminate(docs.limit(0), bench).collect() == []


def test_two_texts_of_one_id_are_tiled_each(spark):
    """A second text of an id, with seeds at the same places, hides nothing of the first; halves of an item in two texts are no leak."""
    item = [f"w{k}" for k in range(20)]
    other = [f"v{k}" for k in range(20)]
    rows = [(1, " ".join(item)), (1, " ".join(item[5:15])), (2, " ".join(item[5:15])), (2, " ".join(item)), (3, " ".join(item[:10])), (3, " ".join(item[10:])), (4, " ".join(item)), (4, " ".join(other)), (4, " ".join(other)), (5, None), (5, " ".join(other[::-1]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    for n in (1, 5):
        out = decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), bench).collect()
        assert sorted({(r["doc_id"], r["n_leaked"], r["item_id"], r["coverage"], r["contaminated"]) for r in out}, key=str) == [(1, 1, 1, 1.0, True), (2, 1, 1, 1.0, True), (3, 0, 1, 0.5, False), (4, 2, 1, 1.0, True), (5, 0, None, 0.0, False)]
        assert len(out) == len(rows)
