"""Suffix-array dedup against brute force over all windows."""

import hashlib
import random

import pytest

from evidloom.llm.suffixdedup import common_prefixes, remove_repeats, two_stage_suffix_array


def brute_force(rows, length):
    """(doc_id, spans, kept bytes) of every row, from the set of each document's windows."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if i is not None and first[raw[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = [k for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((i, len(spans), sum(gone), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], len(r["from_bytes"]), sum(b - a for a, b in zip(r["from_bytes"], r["to_bytes"], strict=True)), hashlib.sha256(bytes(r["left_bytes"])).hexdigest()) for r in df.collect()), key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["thé", "on", "erst", "ing", "ation", "a", "ü", "of the"]
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        t = "".join(rng.choice(parts) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5)))
        rows.append((rng.randint(0, 3 * n), t))
    rows += [rows[3], rows[5], (rows[7][0], rows[8][1]), (999, None), (998, ""), (None, rows[4][1]), (None, None), (997, "a" * 300), (996, "b" + "a" * 200), (995, "ab" * 90)]
    return rows


@pytest.mark.parametrize(("seed", "length"), [(1, 50), (2, 50), (3, 24), (4, 9)])
def test_against_brute_force(spark, seed, length):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(remove_repeats(df, length)) == brute_force(rows, length)


@pytest.mark.parametrize(("chunk", "bucket"), [(1, 4096), (4096, 1), (0, 0), (3, 2)])
def test_hot_anchors(spark, chunk, bucket):
    """A passage in many documents has an own snippet of each at both ends."""
    rng = random.Random(chunk)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage = some(40)
    rows = texts(5, 20) + [(1000 + i, f"{some(12)} {passage[i % 3 :]} {some(9)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(remove_repeats(df, 50, hot_in_chunk=chunk, hot_in_bucket=bucket)) == brute_force(rows, 50)


def test_ids_that_are_no_integers(spark):
    with pytest.raises(TypeError, match="integer"):
        remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"), 50)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 60, "q", 3), (2, "x" * 60, None, 4)], "doc_id long, text string, row string, copy int")
    out = {r["doc_id"]: r for r in remove_repeats(df, 50, keep=("row", "copy")).collect()}
    assert out[1]["from_bytes"] == [] and out[2]["to_bytes"] == [60] and out[2]["copy"] == 4
    assert remove_repeats(df.limit(0), 50).collect() == []


def test_whole_characters(spark):
    body = "é" * 30
    df = spark.createDataFrame([(1, "ab" + body), (2, "xé" + body + "z")], "doc_id long, text string")
    out = {r["doc_id"]: bytes(r["left_bytes"]).decode() for r in remove_repeats(df, 51, whole_characters=True).collect()}
    assert out == {1: "ab" + body, 2: "xz"}


def test_two_stage_order():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 400):
        text = rng.integers(97, 100, n).astype(np.uint8)
        order = two_stage_suffix_array(text, depth=64)
        raw = text.tobytes()
        assert [raw[i : i + 64] for i in order] == sorted(raw[i : i + 64] for i in range(n))
        lcp = common_prefixes(text, order, 20)
        for k in range(1, n):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            want = next((j for j in range(20) if a[j : j + 1] != b[j : j + 1] or j >= len(a)), 20)
            assert lcp[k] == want


def test_a_chunk_takes_little_memory():
    """Two workers of an executor ask at once, beside its JVM and other workers that wait."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from evidloom.llm import suffixdedup

    raw = np.random.default_rng(1).integers(97, 123, 26 << 20, dtype=np.uint8).tobytes()
    rows = [raw[k : k + 8192] for k in range(0, len(raw), 8192)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 500)), pa.array([0] * 500), pa.array(x, pa.binary())], names=["doc_id", "tag", "text"]) for k in range(0, 3000, 500) if len(x := rows[k : k + 500]) == 500]
    tracemalloc.start()
    try:
        n = sum(len(x) for x in suffixdedup._ask(50, 8, 64)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n and peak < 150e6


def test_a_trimmed_task_gives_memory_back(monkeypatch):
    from evidloom.llm import runtime

    calls = []
    monkeypatch.setattr(runtime, "_give_back", lambda: calls.append(1))
    assert list(runtime.trimmed(lambda x: (2 * y for y in x))(iter([1, 2]))) == [2, 4] and calls == [1]
    runtime.trimmed(lambda x: x)(iter([]))  # one that never starts
    some = runtime.trimmed(lambda x: iter(x))(iter([1, 2]))
    next(some)
    some.close()
    assert calls == [1, 1]
