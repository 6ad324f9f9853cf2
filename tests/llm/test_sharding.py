"""Shard sizes, slots, uniformity and repeatability."""

import zlib
from collections import Counter

import numpy as np

from evidloom.llm import sharding
from evidloom.llm.sharding import communication_matrix, shuffle_into_shards


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_exact_sizes_gapless_slots_and_columns(spark):
    texts = ["é", "", None, "abc"] * 250
    df = spark.createDataFrame([(i % 900, t, i) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(6)
    out = rows_of(shuffle_into_shards(df, shards=40))
    sizes = Counter(r[3] for r in out)
    assert len(out) == 1000 and set(sizes.values()) == {25}
    for s in range(40):
        assert sorted(r[4] for r in out if r[3] == s) == list(range(25))
    for i, size, crc, _, _ in out:
        assert (size, crc) in {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts}
    assert sorted(out, key=str) == sorted(rows_of(shuffle_into_shards(df.repartition(3), shards=40)), key=str)


def test_uneven_total_runs_nulls_and_empty(spark):
    df = spark.createDataFrame([(None if i % 50 == 0 else i, str(i)) for i in range(103)], "doc_id long, text string")
    out = rows_of(shuffle_into_shards(df, shards=7, rows_per_run=5))
    sizes = Counter(r[3] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == 103
    assert all(sorted(r[4] for r in out if r[3] == s) == list(range(n)) for s, n in sizes.items())
    assert rows_of(shuffle_into_shards(df.limit(0))) == []


def test_matrix_law():
    counts = [50, 0, 30, 20]
    draws = np.stack([communication_matrix(counts, 5, seed) for seed in range(400)])
    assert (draws.sum(axis=2) == counts).all() and (draws.sum(axis=1) == 20).all()
    mean, var = draws[:, 0, 0].mean(), draws[:, 0, 0].var()
    assert abs(mean - 10) < 0.4 and abs(var - 50 * 0.2 * 0.8 * 50 / 99) < 1.0


def test_draws_of_any_size_keep_the_law():
    room, n = np.array([40, 30, 20, 10]), 30
    rng = np.random.default_rng(3)
    draws = np.stack([sharding.draw(rng, room, n, direct=0) for _ in range(3000)])  # rows one by one, as beyond the generator's range
    assert (draws.sum(axis=1) == n).all() and (draws <= room).all()
    share = room / 100
    assert np.allclose(draws.mean(axis=0), n * share, atol=0.15)
    assert np.allclose(draws.var(axis=0), n * share * (1 - share) * 70 / 99, rtol=0.12)
    room = np.array([3_000_000_000, 1_000_000_000, 2_000_000_000])
    big = sharding.draw(rng, room, 600_000)
    assert big.sum() == 600_000 and np.allclose(big / 600_000, room / 6e9, atol=0.005)


def test_copies_of_one_row_do_not_fill_a_source(spark):
    df = spark.createDataFrame([(7, "same")] * 10_000 + [(None, None)] * 50, "doc_id long, text string").repartition(5)
    out = shuffle_into_shards(df, shards=8, rows_per_run=100)
    rows = rows_of(out)
    assert len(rows) == 10_050 and Counter(Counter(r[3] for r in rows).values()) in (Counter({1256: 6, 1257: 2}), Counter({1257: 2, 1256: 6}))
    biggest = []
    real = sharding.communication_matrix
    sharding.communication_matrix = lambda counts, *a: biggest.append(max(counts)) or real(counts, *a)
    try:
        shuffle_into_shards(df, shards=8, rows_per_run=100)
    finally:
        sharding.communication_matrix = real
    assert biggest[0] < 160  # 101 sources of about 100 rows
    where = sorted((r[3], r[4]) for r in rows if r[0] is None)
    assert len({s for s, _ in where}) > 5  # equal rows do not stay together
