"""Operators on small tables with nulls, ties, repeats and empty inputs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from evidloom import registry
from evidloom.functions import scalars as S
from evidloom.operators import aggregates as A
from evidloom.operators import graphs as G
from evidloom.operators import joins as J
from evidloom.operators import sets as U
from evidloom.operators import streams as ST
from evidloom.operators import windows as W


registry.load()
DATA = os.environ.get("EVIDLOOM_TEST_DATA", "/root/testdata/sf0.001")


def at(hour, day=1):
    return dt.datetime(2024, 1, day, hour)


def test_as_of_join_carries_over_days_and_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, 7, at(1)), (2, 7, at(5, 9)), (3, 7, None), (4, None, at(3)), (5, 8, at(3))], "id int, k int, t timestamp_ntz")
    right = spark.createDataFrame([(7, at(2), 10), (7, at(2), 11), (7, at(4, 2), 12)], "k int, s timestamp_ntz, r int")
    out = {x["id"]: x["match"] and x["match"]["r"] for x in J.as_of_join(left, right, "k", "t", "s", "r").collect()}
    assert out == {1: None, 2: 12, 3: None, 4: None, 5: None}
    same = spark.createDataFrame([(1, 7, at(2))], "id int, k int, t timestamp_ntz")
    assert J.as_of_join(same, right, "k", "t", "s", "r").first()["match"]["r"] == 11  # a tie goes to the larger tie value
    assert J.as_of_join(left.limit(0), right, "k", "t", "s", "r").count() == 0


def test_interval_join_over_slots(spark):
    events = spark.createDataFrame([(1, at(0)), (1, at(23)), (1, at(1, 5))], "k int, t timestamp_ntz")
    spans = spark.createDataFrame([(1, at(23), at(1, 5), "a"), (1, at(2, 6), at(3, 6), "b")], "k int, a timestamp_ntz, b timestamp_ntz, name string")
    assert sorted((r["t"], r["name"]) for r in J.interval_join(events, spans, "k", "t", "a", "b").collect()) == [(at(23), "a"), (at(1, 5), "a")]


def test_episodes(spark):
    rows = [(1, i, s) for i, s in enumerate(["absent", "present", "uncertain", "present", "absent", "absent", "present"])]
    df = spark.createDataFrame(rows, "k int, t int, s string")
    out = sorted(tuple(r) for r in W.episodes(df, ["k"], "t", F.col("s") == "present", F.col("s") == "absent").collect())
    assert out == [(1, 1, 1, 4, 2), (1, 2, 6, None, 1)]


def test_utterances_ignore_blips_and_short_pauses(spark):
    speech = [0, 1, 1, 0] + [1] * 4 + [0] * 2 + [1] * 2 + [0] * 3 + [1] * 5
    df = spark.createDataFrame([(1, i, bool(s)) for i, s in enumerate(speech)], "id int, f long, s boolean")
    assert sorted(tuple(r) for r in ST.utterances(df, "id", "f", F.col("s"), 3, 3).collect()) == [(1, 1, 6, 14), (1, 2, 17, None)]


@pytest.mark.parametrize(("op", "values", "want"), [("AND", [True, None], None), ("AND", [False, None], False), ("AND", [True], True), ("OR", [False, None], None), ("OR", [True, None], True), ("OR", [False], False)])
def test_three_valued_rules(spark, op, values, want):
    df = spark.createDataFrame([(1, op, v) for v in values], "k int, op string, v boolean")
    assert G.combined(df, ["k"], "op", "v").first()["v"] is want


def test_components_and_closure_with_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (8, 8), (20, 9)], "a long, b long")
    assert {r["node"]: r["component"] for r in G.components(e, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 8}
    up = {(r["node"], r["ancestor"]): r["depth"] for r in G.closure(e, "a", "b").collect()}
    assert up[1, 3] == 2 and up[1, 1] == 3 and up[20, 8] == 2
    assert G.closure(e.limit(0), "a", "b").count() == 0


def test_holm_and_ranks_with_ties(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.01), ("f", 0.04), ("f", 0.5)], "k string, p double")
    assert sorted(round(r["p_adjusted"], 6) for r in A.holm(df, "p", ["k"]).collect()) == [0.04, 0.04, 0.08, 0.5]
    ties = spark.createDataFrame([(1, 5), (1, 5), (1, 9)], "k int, s int")
    assert sorted(r["rank"] for r in W.pessimistic_rank(ties, "s", ["k"]).collect()) == [1, 3, 3]
    assert sorted(r["rank"] for r in W.average_rank(ties, "s", ["k"]).collect()) == [1.5, 1.5, 3.0]


def test_auroc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, False), ("b", 1, True)], "k string, s int, y boolean")
    assert {r["k"]: r["auroc"] for r in A.auroc(df, "s", "y", ["k"]).collect()} == {"a": None, "b": 0.5}


def test_scalars(spark):
    row = spark.range(1).select(S.list_literal(F.lit("['E_1', 'E_2_@_V_3']")).alias("l"), S.plain_id(F.lit(" 123.0")).alias("i"), S.plain_id(F.lit("")).alias("e"), S.finite(F.lit("inf")).alias("x"), S.severity(F.lit("7/10점 → 4/10점")).alias("s"), S.full_hash_modulo(F.lit("abc"), 5).alias("h")).first()
    import hashlib

    assert row["l"] == ["E_1", "E_2_@_V_3"] and row["i"] == "123" and row["e"] is None and row["x"] is None and row["s"] == 0.4
    assert row["h"] == int(hashlib.sha256(b"abc").hexdigest(), 16) % 5


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r["k"], r["side"]) for r in U.symmetric_difference(a, b, "k").collect()} == {(1, "MISSING"), (3, "EXTRA")}
    rows = spark.createDataFrame([(1, "x", 2), (1, "x", 1), (2, "x", 1), (2, "y", 2)], "k int, s string, o int")
    assert [(r["k"], r["o"]) for r in U.without_conflicts(rows, "k", "s", "o").collect()] == [(1, 1)]


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    from evidloom.streaming import stateful

    frames = spark.createDataFrame([(1, i, i >= 2) for i in range(6)], "stream_id long, frame_no long, speech boolean")
    frames.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    name = f"restart-{tmp_path.name}"
    first = stateful.run_to_table(stateful.endpoints(read(), 3, 2), name).collect()
    assert [(r["kind"], r["frame_no"]) for r in first] == [("start", 4)]
    spark.createDataFrame([(1, i, False) for i in range(6, 9)], frames.schema).write.mode("append").parquet(str(tmp_path / "in"))
    again = stateful.run_to_table(stateful.endpoints(read(), 3, 2), name).collect()
    assert sorted((r["kind"], r["frame_no"]) for r in again) == [("end", 7), ("start", 4)]


def test_stitched_tags_against_a_loop(spark):
    import random

    from evidloom.operators.reports import stitched_tags, window_starts

    def stitch(starts, windows):
        tags = list(windows[0])
        for start, own in zip(starts[1:], windows[1:], strict=True):
            middle = (start + len(tags)) // 2
            free = [at for at in range(start, len(tags)) if tags[at] == "O" == own[at - start]]
            cut = min(free, key=lambda at: (abs(at - middle), at), default=middle)
            tags = tags[:cut] + own[cut - start :]
            if cut > 0 and tags[cut - 1] != "O":
                kind, at = tags[cut - 1][2:], cut
                while at < len(tags) and tags[at].startswith("I-"):
                    tags[at], at = f"I-{kind}", at + 1
        return tags

    rng, rows, want = random.Random(2), [], {}
    for i in range(120):
        n, size, step = rng.randint(1, 30), 8, rng.choice([3, 5, 7])
        starts = [0] if n <= size else [*range(0, n - size, step), n - size]
        windows = [[rng.choice(["O", "O", "B-X", "I-X", "I-Y"]) for _ in range(min(size, n))] for _ in starts]
        rows.append((i, n, step, list(zip(starts, windows, strict=True))))
        want[i] = stitch(starts, windows)
    df = spark.createDataFrame(rows, "id int, n int, step int, w array<struct<start: int, tags: array<string>>>")
    assert {r["id"]: list(r["t"]) for r in df.select("id", stitched_tags(F.col("w")).alias("t")).collect()} == want
    for step in (3, 5, 7):
        got = df.where(F.col("step") == step).select("n", window_starts(F.col("n"), 8, step).alias("s"), "w").collect()
        assert all(list(r["s"]) == [x["start"] for x in r["w"]] for r in got)


def test_power_table_is_the_normal_approximation(spark):
    from statistics import NormalDist

    from evidloom import registry

    normal, rows = NormalDist(), registry.QUERIES["C32_power_table"](spark, "").collect()
    assert len(rows) == 144
    for r in rows:
        assert abs(r["power"] - normal.cdf((r["margin"] - r["delta"]) / (r["d"] / r["n"]) ** 0.5 - normal.inv_cdf(1 - r["level"]))) < 1e-12


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    """The second run knows only what the first left in the shared folder; a run without new data changes nothing."""
    import uuid

    from evidloom.streaming import stateful

    name, src = f"upsert-{uuid.uuid4().hex}", str(tmp_path / "in")

    def merge(batch, before):
        now = batch.groupBy("k").agg(F.count("*").alias("n"))
        return now if before is None else now.unionByName(before).groupBy("k").agg(F.sum("n").alias("n"))

    run = lambda: sorted(tuple(r) for r in stateful.upsert_batches(spark.readStream.schema("k string").parquet(src), name, merge).collect())
    spark.createDataFrame([("a",)], "k string").write.parquet(src)
    assert run() == [("a", 1)]
    spark.createDataFrame([("a",), ("b",)], "k string").coalesce(1).write.mode("append").parquet(src)
    assert run() == [("a", 2), ("b", 1)]
    assert run() == [("a", 2), ("b", 1)]


def test_components_of_a_hot_node(spark):
    edges = [(5000, i) for i in range(10, 3000)] + [(2999, 7), (9000, 9001)]
    out = G.components(spark.createDataFrame(edges, "x long, y long").repartition(5), "x", "y").collect()
    assert {r["node"]: r["component"] for r in out} == {**{i: 7 for i in range(10, 3000)}, 7: 7, 5000: 7, 9000: 9000, 9001: 9000}


def test_folds_are_dealt_in_hash_order(spark):
    import hashlib

    rows = [(i, s) for i in range(700) for s in (("a",) if i % 3 else ("b", None))]
    out = W.round_robin_folds(spark.createDataFrame(rows, "i int, s string"), "s", F.col("i").cast("string"), 5).collect()
    for s in ("a", "b", None):
        order = sorted((i for i, x in rows if x == s), key=lambda i: (hashlib.sha256(str(i).encode()).hexdigest(), str(i)))
        assert {r["i"]: r["fold"] for r in out if r["s"] == s} == {i: k % 5 for k, i in enumerate(order)}


def test_particles_wording_and_audit(spark):
    words = {"두통 은": "두통", "병원에서는": "병원", "은": "은", "집으로는": "집", None: None, "fever": "fever"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", S.without_particles(F.col("w")).alias("s")).collect()} == words
    texts = {"You MUST rest; it can help, it must": ("MIXED", ["must", "can"]), "mustard, cannot": ("UNMARKED", []), "required, recommended": ("STRONG", ["recommended", "required"]), None: ("UNMARKED", []), "Optional": ("PERMISSIVE", ["optional"])}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.wording(F.col("t")).alias("w"))
    assert {r["t"]: (r["w"]["strength"], r["w"]["markers"]) for r in df.collect()} == texts
    rows = [(["REJECTED"], "D", "REJECTED"), (["G1"], "D", "HELD"), (["REJECTED", "G2_SILVER_AGREED"], "D", "KEEP_NEW_CANDIDATE"), (["G3_SILVER_AUDITED"], "B", "MERGE_AS_EXISTING_RELATION"), (["G3_SILVER_AUDITED"], "E", "REJECTED"), (["G3_SILVER_AUDITED"], None, "HELD")]
    df = spark.createDataFrame(rows, "g array<string>, c string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", S.audit_decision(F.col("g"), F.col("c")).alias("got")).collect())


def test_alias_table_and_policy_violations(spark):
    from evidloom.operators import validation as V

    rows = [("ok", "E_1", "{NOT}pain", "noun", ["P"], None), ("no", "E_9", "x", None, None, "P"), ("twice", "E_1", "a", "noun", ["P"], None), ("twice", "E_1", "a*", "noun", [], "Q"), ("bad", "E_2", None, "verb", ["Q"], None), ("macro", "E_3", "{ANY}", "noun", ["P"], None)]
    aliases = spark.createDataFrame(rows, "id string, evidence_id string, pattern string, kind string, allow array<string>, status string")
    catalogue = spark.createDataFrame([("E_1", "B"), ("E_2", "C"), ("E_3", "B")], "evidence_id string, data_type string")
    out = lambda a: sorted(tuple(r) for r in V.alias_violations(a, catalogue, ("P", "N"), excluded=("E_3",), macros={"NOT": "no "}).collect())
    assert out(aliases) == [("bad", "BAD_ALLOW"), ("bad", "BAD_KIND"), ("bad", "EMPTY_PATTERN"), ("bad", "NOT_BINARY"), ("macro", "EXCLUDED_EVIDENCE"), ("macro", "UNRESOLVED_MACRO"), ("no", "UNKNOWN_EVIDENCE"), ("twice", "BAD_ALLOW"), ("twice", "BAD_STATUS"), ("twice", "DUPLICATE_ID"), ("twice", "MATCHES_EMPTY")]
    assert out(aliases.limit(0)) == []
    policy = spark.createDataFrame([("E_1", True, "r"), ("E_1", True, ""), ("E_8", None, "r")], "evidence_id string, allowed boolean, reason string")
    got = sorted(tuple(r) for r in V.policy_violations(policy, catalogue.where("data_type = 'B'")).collect())
    assert got == [("E_1", "DUPLICATE"), ("E_1", "NO_REASON"), ("E_3", "MISSING"), ("E_8", "EXTRA"), ("E_8", "NO_REASON")]


def test_shortest_paths_end_on_cycles(spark):
    e = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 4), (4, 3), (5, 4), (5, 2), (6, 1), (6, 2)], "child long, parent long")
    assert {r["node"]: r["path"] for r in G.first_shortest_paths(e).collect()} == {1: "1>0", 2: "2>0", 5: "5>2>0", 6: "6>1>0"}
    assert G.first_shortest_paths(e.limit(0)).count() == 0


def test_stratified_draws_keep_the_sizes_of_strata(spark):
    rows = [(i, "a" if i < 900 else "b", 10.0 if i < 900 else 110.0) for i in range(1000)]
    b = A.stratified_bootstrap(spark.createDataFrame(rows, "i int, s string, v double"), "s", "i", "v", 30, 5).collect()
    assert len(b) == 30 and all(abs(r["estimate"] - 20.0) < 1e-9 for r in b)
    spread = A.stratified_bootstrap(spark.createDataFrame([(i, "a", float(i)) for i in range(400)], "i int, s string, v double"), "s", "i", "v", 200, 5).collect()
    assert 4.0 < (sum((r["estimate"] - 199.5) ** 2 for r in spread) / 200) ** 0.5 < 8.0  # 115.5 / 20 in theory


def test_mentions_of_one_time_are_neither_before_nor_after(spark, tmp_path):
    from evidloom import registry

    # event_id % 5: 0 positive, 1 negative.
    rows = [(0, at(1), 1, "error"), (5, at(2), 1, "error"), (10, at(2), 1, "purchase"), (1, at(2), 1, "error"), (6, at(3), 1, "error")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in registry.QUERIES["C19_resolution_linking"](spark, str(tmp_path)).collect()] == [(10, 0)]
    got = {r["obs_id"]: r["resolved_at"] for r in registry.QUERIES["C20_later_absence_resolves"](spark, str(tmp_path)).collect()}
    assert got == {0: at(2), 5: at(3)}


def test_nearest_leakage_neighbour_against_a_loop(spark, tmp_path):
    import difflib
    import random

    from evidloom import registry

    rng = random.Random(4)
    names = {i: " ".join(rng.choice(["red", "bolt", "gear", "old", "cold"]) for _ in range(rng.randint(1, 3))) for i in range(60)}
    spark.createDataFrame(list(names.items()), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    first = {}
    for i in sorted(names):
        first.setdefault(names[i], i)
    want = {}
    for a, i in first.items():
        near = [(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), j) for b, j in first.items() if j % 5 and set(a.split()) & set(b.split())]
        if i % 5 == 0 and near:
            want[i] = (max(near)[1], max(near)[0])
    assert want and {r["test_id"]: (r["id"], r["ratio"]) for r in registry.QUERIES["C18_nearest_leakage_neighbour"](spark, str(tmp_path)).collect()} == want


def test_question_scores_by_blocks_equal_a_plain_loop(spark, monkeypatch):
    import math
    import random

    from evidloom.operators import simulation as S

    rng = random.Random(2)
    labels, questions = ["a", "b", "c", "d"], {f"q{k}": [f"v{j}" for j in range(1 + k % 3)] for k in range(9)}
    like = {(q, v, x): rng.random() for q, vs in questions.items() for v in vs for x in labels if rng.random() < 0.9}
    post = {i: {x: p for x, p in zip([*labels, "unknown"], [rng.random() for _ in range(5)], strict=True) if rng.random() < 0.8} for i in range(40)}
    bits = lambda p: -p * math.log2(p) if p > 0 else 0.0

    def gain(case, q):
        parts = [[p * like.get((q, v, x), 0.0) for x, p in case.items()] for v in questions[q]]
        return sum(map(bits, case.values())) - sum(sum(map(bits, j)) - bits(sum(j)) for j in parts)

    held = {q for q, _, _ in like}
    table = spark.createDataFrame([(*k, p) for k, p in like.items()], "q string, v string, x string, p double")
    rows = spark.createDataFrame([(i, [(x, p) for x, p in sorted(c.items())]) for i, c in post.items()], "i long, post array<struct<label: string, p: double>>")
    for block_rows, product in ((2_000_000, 2_000_000), (10, 50)):
        monkeypatch.setattr(S, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(S, "PRODUCT", product)
        got = {(r["i"], r["q"]): r["ig"] for r in S.information_gain(rows, table, "i", "q", "v", "x").collect()}
        assert set(got) == {(i, q) for i in post for q in held}
        assert all(abs(g - gain(post[i], q)) < 1e-9 for (i, q), g in got.items())
    assert S.information_gain(rows, table.limit(0), "i", "q", "v", "x").count() == 0


def test_scores_of_many_labels_and_of_few_are_a_loops(spark, monkeypatch):
    import math

    from evidloom.operators import simulation

    labels, answers = [f"l{k}" for k in range(5)], [(q, v) for q in "ab" for v in "xyz"]
    p = {(q, v, n): 0.1 + 0.1 * ((i * 7 + k * 3) % 8) for i, (q, v) in enumerate(answers) for k, n in enumerate(labels)}
    given = [(c, *answers[(c * m) % 6]) for c in range(30) for m in (1, 2)] + [(99, "a", "never seen")]
    like = spark.createDataFrame([(*k, x) for k, x in p.items()], "q string, v string, label string, p double")
    asked = spark.createDataFrame(given, "case long, q string, v string")
    want = {(c, n): round(sum(math.log(p[q, v, n]) for d, q, v in given if d == c), 9) for c in range(30) for n in labels}
    for most in (64, 2):
        monkeypatch.setattr(simulation, "LABELS", most)
        scores = simulation.case_scores(asked, like, "case", ["q", "v"], "label")
        assert {(r["case"], r["label"]): round(r["ll"], 9) for r in scores.select("case", F.inline("scores")).collect()} == want
        kept = simulation.pruned(F.col("scores"), 0.5)
        top = {c: max(x for (d, _), x in want.items() if d == c) for c in range(30)}
        assert {(r["case"], r["label"]) for r in scores.select("case", F.inline(kept)).collect()} == {k for k, x in want.items() if x - top[k[0]] >= math.log(0.5)}


def test_a_cases_answers_are_shuffled_once(spark):
    for name in ("F38_log_likelihood", "F40_softmax", "I5_reversible_pruning", "I6_posterior_update"):
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_many_edges_are_never_broadcast_and_depth_is_bounded(spark, monkeypatch):
    edges = spark.range(1, 400).selectExpr("id AS c", "id div 2 AS p").unionByName(spark.createDataFrame([(0, 5)], "c long, p long"))
    up = {r["c"]: set() for r in edges.collect()}
    for r in edges.collect():
        up[r["c"]].add(r["p"])

    def want(most):
        out = {}
        for n in up:
            at, depth = up[n], 1
            while at and depth <= most:
                out |= {(n, x): depth for x in at if (n, x) not in out}
                at, depth = {y for x in at for y in up.get(x, ()) if (n, y) not in out}, depth + 1
        return out

    plans = []
    whole = G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    monkeypatch.setattr(G, "BROADCAST_EDGES", 100, raising=False)
    for most in (3, 1, None):
        got = G.closure(edges, "c", "p", **({"most": most} if most else {}))
        assert {(r["node"], r["ancestor"]): r["depth"] for r in got.collect()} == want(most or 99)
    assert plans and not any("Broadcast" in x for x in plans)


def test_a_shortest_path_is_written_once_for_each_node(spark, monkeypatch):
    """Walking up would write every node once for each level above it."""
    edges = spark.range(1, 500).selectExpr("id AS child", "explode(array_distinct(array(id div 2, id div 3))) AS parent")
    written = []
    whole = G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(df.count()) or whole(df))
    got = {r["node"]: r["path"] for r in G.first_shortest_paths(edges).collect()}
    best = {0: (0, "0")}
    for n in range(1, 500):
        depth = 1 + min(best[p][0] for p in (n // 2, n // 3))
        best[n] = depth, min(f"{n}>{best[p][1]}" for p in (n // 2, n // 3) if best[p][0] == depth - 1)
    assert got == {n: p for n, (_, p) in best.items() if n}
    assert sum(written) <= edges.count() + len(got)


def test_answers_that_count_once_move_as_one_number(spark, monkeypatch):
    from evidloom.operators import aggregates, simulation

    given = [(c, q, v) for c in range(40) for q, v in (("a", "xyz"[c % 3]), ("b", "xyz"[c % 2]), ("a", "xyz"[c * c % 3]))] * 3 + [(7, None, "x"), (8, "a", "new")]
    asked = spark.createDataFrame(given, "case long, q string, v string")
    labels = spark.createDataFrame([(c, f"l{c % 3}") for c in range(39)], "case long, label string")
    like = aggregates.smoothed_likelihood(asked.dropna().distinct(), labels, "case", "label", "q", "v")
    want = {(r["q"], r["v"], r["label"]): r["p"] for r in like.collect()}
    assert {(r["q"], r["v"], r["label"]): r["p"] for r in aggregates.smoothed_likelihood(asked.dropna(), labels, "case", "label", "q", "v", once=True).collect()} == want
    read = lambda df: {(r["case"], r["label"]): round(r["ll"], 9) for r in df.select("case", F.inline("scores")).collect()}
    scores = read(simulation.case_scores(asked.distinct(), like, "case", ["q", "v"], "label"))
    got = simulation.case_scores(asked, like, "case", ["q", "v"], "label", once=True)
    assert read(got) == scores and len(scores) == 120
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_bit_or" in plan
    for module in (simulation, aggregates):
        monkeypatch.setattr(module, "ANSWERS", 2)
    assert read(simulation.case_scores(asked, like, "case", ["q", "v"], "label", once=True)) == scores


def _above(rows):
    """{(node, ancestor): depth} by a loop; null edges start and end walks, and no walk goes on from null."""
    up = {}
    for c, p in rows:
        up.setdefault(c, set()).add(p)
    out = {}
    for n in up:
        at, depth = up[n], 1
        while at:
            out |= {(n, x): depth for x in at}
            at, depth = {y for x in at if x is not None for y in up.get(x, ()) if (n, y) not in out}, depth + 1
    return out


def test_pairs_of_a_closure_are_not_written(spark, monkeypatch):
    import random

    rng = random.Random(6)
    rows = [(n, n // k) for n in range(1, 300) for k in (2, 3)] + [(500, 501), (501, 502), (502, 500), (510, 500), (None, 7), (501, None)] + [(rng.randrange(600, 640), rng.randrange(600, 640)) for _ in range(60)]
    want = _above(rows)
    written = []
    whole = G.Levels.add
    monkeypatch.setattr(G.Levels, "add", lambda self, df: written.append((out := whole(self, df)).count()) or out)
    get = lambda e: sorted(((r["node"], r["ancestor"], r["depth"]) for r in G.closure(e, "c", "p").collect()), key=str)
    edges = spark.createDataFrame(rows, "c long, p long")
    assert get(edges) == sorted(((*k, d) for k, d in want.items()), key=str)
    assert sum(written) < len(want)
    named = edges.selectExpr("concat('t', c) AS c", "concat('t', p) AS p")
    name = lambda x: None if x is None else f"t{x}"
    for bits, most, cells in ((3, 20, 50), (2, 2_000_000, 1), (11, 1, 1 << 22)):
        monkeypatch.setattr(G, "BLOCK_BITS", bits)
        monkeypatch.setattr(G, "BLOCK_EDGES", most)
        monkeypatch.setattr(G, "CELLS", cells)
        assert get(named) == sorted(((name(n), name(a), d) for (n, a), d in want.items()), key=str)


def test_specificity_moves_counts_and_no_pairs(spark, monkeypatch):
    rows = [(n, n // k) for n in range(1, 400) for k in (2, 3)] + [(500, 501), (501, 500), (502, None)]
    want = _above(rows)
    n = {}
    for _, a in want:
        n[a] = n.get(a, 0) + 1
    sums = {}
    for x, a in want:
        if a is not None:
            sums[x] = sums.get(x, 0) + 1 / n[a]
    written = []
    whole = G.Levels.add
    monkeypatch.setattr(G.Levels, "add", lambda self, df: written.append((out := whole(self, df)).count()) or out)
    for bits, most in ((11, 2_000_000), (4, 60)):
        monkeypatch.setattr(G, "BLOCK_BITS", bits)
        monkeypatch.setattr(G, "BLOCK_EDGES", most)
        got = {r["node"]: r["specificity"] for r in G.specificity(spark.createDataFrame(rows, "c long, p long"), "c", "p").collect()}
        assert got.keys() == sums.keys() and all(abs(got[k] - v) < 1e-9 for k, v in sums.items())
        assert most < 100 or sum(written) < len(want)


def test_ancestors_are_carried_up_as_arrays(spark, monkeypatch):
    from evidloom.plans import graphs as plans

    rows = [(n, n // k) for n in range(1, 300) for k in (2, 3)] + [(500, 501), (501, 500)]
    want = _above(rows)
    edges = spark.createDataFrame(rows, "child long, parent long").distinct()
    rec = [(p, (p * 37 + k * k * 11) % 320, "RNA"[(p + k) % 3]) for p in range(40) for k in range(12)] + [(1, 500, "R"), (2, 501, "R"), (2, 500, "N"), (None, 8, "R"), (None, 4, "A")]
    rec = list({(p, t): f for p, t, f in rec}.items())
    has = {k for k, _ in rec if k[0] is not None}
    up = {(p, a) for (p, t), f in rec if f == "R" for n, a in want if n == t and (p, a) not in has}
    frame = spark.createDataFrame([(p, t, f) for (p, t), f in rec], "patient long, term long, flag string")
    for bits, most, values in ((11, 2_000_000, 1 << 20), (4, 60, 7)):
        monkeypatch.setattr(G, "BLOCK_BITS", bits)
        monkeypatch.setattr(G, "BLOCK_EDGES", most)
        monkeypatch.setattr(G, "BATCH_VALUES", values)
        out = plans.propagated(frame, edges)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == up
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(patient" in plan and "hashpartitioning(patient#" in plan and ", term#" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)


def test_levels_of_many_paths_are_not_sent_to_the_driver(spark, monkeypatch):
    """Small files would make adaptive execution broadcast a level, which the driver has to hold."""
    monkeypatch.setattr(G, "BROADCAST_PATHS", 50, raising=False)
    monkeypatch.setattr(G, "BROADCAST_EDGES", 50)
    store = spark._jsparkSession.sharedState().statusStore()
    last = max([x.executionId() for x in _each(store.executionsList())], default=-1)
    edges = spark.range(1, 3000).selectExpr("id AS child", "explode(array_distinct(array(id div 2, id div 3))) AS parent")
    assert G.first_shortest_paths(edges).count() == 2999
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sent = []
    for x in _each(store.executionsList()):
        if x.executionId() > last:
            values = store.executionMetrics(x.executionId())
            for node in _each(store.planGraph(x.executionId()).allNodes()):
                if node.name() == "BroadcastExchange":
                    sent += [values.get(m.accumulatorId()).get() for m in _each(node.metrics()) if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    assert max([int(v.replace(",", "")) for v in sent], default=0) <= 50


def _each(seq):
    return [seq.apply(k) for k in range(seq.size())]
