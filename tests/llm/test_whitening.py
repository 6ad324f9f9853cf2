"""Whitening against a whole decomposition of the covariance, and its edge cases."""

import numpy as np
import pytest

from evidloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)


def brute(rows, k):
    x = [(i, np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000) for i, v in rows]
    fit = np.unique(np.array([v for _, v in x]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, {i: ((n * v - s) / n) @ u / np.sqrt(e) for i, v in x}, {i: int(((n * v - s) ** 2).sum()) for i, v in x}, e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("steep", [False, True])
def test_equals_a_whole_decomposition(spark, steep):
    rng = np.random.default_rng(5)
    d = 48
    scale = 200 * 0.2 ** np.arange(d) if steep else np.full(d, 9.0)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    rows = [(i, (rng.standard_normal(d) * scale @ turn).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(40)]  # a hot vector counts once
    k = 4 if steep else 16
    got = W.whiten(rows_of(spark, rows), components=k).toPandas()
    n, white, deviation, share = brute(rows, k)
    assert len(got) == len(rows) * k and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    want = np.array([white[i] for i in table.index])
    sign = np.sign((table.to_numpy() * want).sum(axis=0))
    assert np.abs(table.to_numpy() * sign - want).max() < 1e-7
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == deviation
    assert np.allclose(got.groupby("component")["explained"].first(), share, rtol=1e-9)


def test_steep_spectra_need_no_full_basis_and_flat_ones_do(spark):
    rng = np.random.default_rng(7)
    flat = rng.standard_normal((200, 60)) * 64
    whole = lambda m: spark.createDataFrame([([int(x) for x in r],) for r in m], "x array<long>")
    exact = np.round(rng.standard_normal((200, 5)) * 50) @ np.round(rng.standard_normal((5, 60)) * 3)
    assert not W.fit_whitener(whole(exact).distinct(), components=5).full
    assert W.fit_whitener(whole(flat).distinct(), components=5).full


def test_edges(spark):
    good = [(1, [1.0, 2.0, 0.0]), (2, [2.0, 1.0, 0.0]), (3, [4.0, 4.0, 0.0]), (3, [4.0, 4.0, 0.0]), (None, [1.0, 2.0, 0.0])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("-inf"), 1.0, 1.0]), (9, [1.0]), (10, [])]
    got = W.whiten(rows_of(spark, good + bad)).collect()
    # Three distinct vectors span two components; the constant place spans none.
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c) for i, _ in good for c in (1, 2))
    assert max(r["identity_error"] for r in got) < 1e-9
    for empty in ([], [(1, [])], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = W.whiten(rows_of(spark, empty))
        assert out.count() == 0 and out.columns[:6] == ["vec_id", "component", "n", "deviation", "whitened", "explained"]


def test_deviations_are_exact_or_null():
    assert W.deviations(np.array([[1 << 31, 3], [1 << 32, 5]])) == [(1 << 62) + 9, None]
    assert W.deviations(np.array([[3, 4]])) == [25]
    assert W.deviations(np.array([[(1 << 31) + 1, 0]])) == [((1 << 31) + 1) ** 2]
