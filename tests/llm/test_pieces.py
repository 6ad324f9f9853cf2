"""SentencePiece lattice against a plain Viterbi over the same piece table, and exact round trips."""

import random

import pytest

from evidloom.llm import pieces


@pytest.fixture(scope="module")
def table():
    return pieces.load_pieces()


def viterbi(text, table, scores):
    """Best ids by summed scores; ties take the longer last piece; unknown characters become bytes."""
    s = pieces.SPACE
    text = (" " + text.replace(s, " ")).replace(" ", s) if text else ""
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        found = []
        for start in range(max(0, end - table.longest), end):
            hit = scores.get(text[start:end])
            if hit is not None:
                found.append((best[start][0] + hit[1], start, [*best[start][1], hit[0]]))
            elif end == start + 1:
                raw = text[start].replace(s, " ").encode()
                found.append((best[start][0] + table.unknown_score, start, [*best[start][1], *(table.byte_ids[b] for b in raw)]))
        top = max(found, key=lambda f: (f[0], -f[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


TEXTS = ["Hello world", "", None, " two  spaces   here ", "naïve café — 漢字 🙂", "a\nb\tc\r\n", "▁raw▁", "x" * 700, "the the the", "antidisestablishmentarianism of heertion", "\x00\x01 ok", "é"]


@pytest.mark.parametrize("bound", [pieces.BROADCAST_BYTES, 400, 0])
def test_ids_and_round_trip(spark, table, bound):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ther onsé.\n, 9") for _ in range(rng.randint(1, 80))) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the end"), (0, "Hello world")]
    out = pieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), table, broadcast_bytes=bound).collect()
    scores = {p: (i, s) for p, i, s in zip(table.pieces, table.ids, table.scores, strict=True)}
    assert len(out) == len(rows)
    for r in out:
        t = "the end" if r["doc_id"] is None else texts[r["doc_id"]]
        assert r["decoded"] == (t or "").replace(pieces.SPACE, " ")
        assert list(r["ids"]) == viterbi(t or "", table, scores), t


def test_decode_and_empty(spark, table):
    df = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, ids string")
    enc = pieces.encode_documents(df, table)
    back = pieces.decode_ids(spark, enc, table).collect()
    assert back[0]["text"] == "some text"
    assert pieces.encode_documents(df.limit(0), table).collect() == []


@pytest.mark.parametrize("bound", [pieces.BROADCAST_BYTES, 0])
def test_kept_columns(spark, table, bound):
    df = spark.createDataFrame([(1, "some text", "x", 7, "e"), (1, "some text", "y", 8, None)], "doc_id long, text string, row string, extra int, `a b` string")
    out = pieces.encode_documents(df, table, broadcast_bytes=bound, keep=("row", "extra", "a b", "text"))
    assert out.columns == ["doc_id", "row", "extra", "a b", "text", "ids", "decoded"]
    assert sorted((r["row"], r["extra"], r["a b"], r["decoded"]) for r in out.collect()) == [("x", 7, "e", "some text"), ("y", 8, None, "some text")]
    with pytest.raises(ValueError, match="clash"):
        pieces.encode_documents(df.withColumn("ids", df["row"]), table, keep=("ids",))


def test_broadcast_holds_plain_arrays(spark, table):
    """Executors without the package can load it."""
    import pickle
    import pickletools

    units = spark.createDataFrame([(" some",), (" text",)], "unit string")
    raw = pickle.dumps(pieces._collected(pieces.encode_units(units, table)))
    assert "evidloom" not in {str(arg).split(" ")[0].split(".")[0] for _, arg, _ in pickletools.genops(raw)}


def linear_viterbi(text, table, scores):
    """As viterbi(), with back pointers, for texts without characters that are no piece."""
    text = "▁" + text.replace(" ", "▁")
    longest, best, back = table.longest, [0.0], [None]
    for end in range(1, len(text) + 1):
        found = [(best[start] + scores[text[start:end]][1], -start, scores[text[start:end]][0]) for start in range(max(0, end - longest), end) if text[start:end] in scores]
        score, start, i = max(found)
        best.append(score)
        back.append((-start, i))
    ids, end = [], len(text)
    while end:
        end, i = back[end]
        ids.append(i)
    return ids[::-1]


@pytest.mark.parametrize("bound", [pieces.BROADCAST_BYTES, 0])
def test_long_runs_stay_whole(spark, table, bound):
    import string

    rng = random.Random(7)
    base64, hexes = string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    run = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    scores = {p: (i, s) for p, i, s in zip(table.pieces, table.ids, table.scores, strict=True)}
    texts = ["x" * 700, " " * 700, run(base64, 700), run(hexes, 700), "a漢é🙂b" * 120]
    want = [viterbi(t, table, scores) for t in texts]
    assert want[:4] == [linear_viterbi(t, table, scores) for t in texts[:4]]
    texts += ["x" * 5000, run(base64, 5000), run(hexes, 5000), "short words " * 50, run(string.ascii_lowercase, 200_000)]  # the last has more ids than two bytes count
    want += [linear_viterbi(t, table, scores) for t in texts[5:]]
    out = pieces.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table, broadcast_bytes=bound).collect()
    assert len(out) == len(texts) and len(want[-1]) > 1 << 16
    for r in out:
        assert r["decoded"] == texts[r["doc_id"]]
        assert list(r["ids"]) == want[r["doc_id"]], texts[r["doc_id"]][:60]


def test_lattice_explodes_few_substrings(spark, table):
    """All edges of the lattice need few more rows than there are edges, counted in Spark's own metrics."""
    rng = random.Random(5)
    units = sorted({" " + "".join(rng.choice(["th", "er", "ous", "en", "ing", "a", "gra", "ß"]) for _ in range(rng.randint(3, 7))) for _ in range(300)})
    scores = {p: (i, s) for p, i, s in zip(table.pieces, table.ids, table.scores, strict=True)}
    marked = [u.replace(" ", pieces.SPACE) for u in units]
    edges = sum(1 for u in marked for a in range(len(u)) for b in range(a + 1, min(len(u), a + table.longest) + 1) if u[a:b] in scores or b == a + 1)
    out = pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), table, any_long=False).collect()
    assert {r["unit"]: list(r["ids"]) for r in out} == {u: viterbi(u[1:], table, scores) for u in units}
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, nodes, made = store.executionMetrics(last), store.planGraph(last).allNodes(), []
    for k in range(nodes.size()):
        if nodes.apply(k).name() == "Generate":
            metrics = nodes.apply(k).metrics()
            made += [int(values.apply(metrics.apply(m).accumulatorId()).replace(",", "")) for m in range(metrics.size()) if metrics.apply(m).name() == "number of output rows"]
    assert made and edges <= max(made) <= 2 * edges


def test_ties_take_the_longer_last_piece(spark, table):
    scores = {"a": -3.0, "b": -3.0, "c": -3.0, "ab": -4.0, "bc": -4.0, "abc": -7.0, "cab": -7.0, "bcabc": -11.0, "abcabc": -14.0}
    small = pieces.PieceTable(list(scores), list(range(300, 300 + len(scores))), list(scores.values()), list(range(256)), 400)
    by_piece = {p: (i, s) for p, i, s in zip(small.pieces, small.ids, small.scores, strict=True)}
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["abc", "abcabc", "bcabc"]
    out = pieces.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), small).collect()
    assert len(out) == len(texts)
    for r in out:
        assert list(r["ids"]) == viterbi(texts[r["doc_id"]], small, by_piece), texts[r["doc_id"]]
