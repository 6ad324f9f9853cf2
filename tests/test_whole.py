"""Registered queries hold every id, not only some."""

import os

from evidloom import registry
from pyspark.sql import functions as F

registry.load()
DATA = os.environ.get("EVIDLOOM_TEST_DATA", "/root/testdata/sf0.001")


def test_every_term_has_ancestors_depth_and_path(spark):
    terms = {r[0] for r in spark.read.parquet(f"{DATA}/part.parquet").where("p_partkey > 0").select("p_partkey").collect()}
    for name in ("G1_ancestors", "G3_shortest_path", "G4_minimum_depth", "G14_structural_specificity"):
        assert {r["node"] for r in registry.QUERIES[f"{name}"](spark, DATA).select("node").collect()} == terms


def test_pairs_and_records_of_every_term(spark):
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    assert registry.QUERIES["G17_semantic_relation"](spark, DATA).count() == li.select("l_partkey", "l_suppkey").distinct().count()
    n = registry.QUERIES["A38_closure_coverage"](spark, DATA).groupBy().sum("n_terms").first()[0]
    assert n == li.where("l_quantity > 40").select("l_suppkey", "l_partkey").distinct().count()


def test_every_patient_vector_query_and_pair(spark):
    at = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    run = lambda n: registry.QUERIES[f"{n}"](spark, DATA)
    users = at("events").select("user_id").distinct().count()
    assert run("C5_failure_cause").count() == run("W14_inherited_back").count() == run("X12_clinical_summary").select("patient").distinct().count() == users
    assert run("SRC20_long_dense_table").select("vec_id").distinct().count() == at("embeddings").count()
    assert run("W13_non_overlapping_spans").count() == at("orders").select("o_custkey").distinct().count()
    assert run("C6_match_classes").count() == at("part").count() * at("supplier").count()
    assert run("T8_overlap_preselect").select("query_id").distinct().count() == at("part").count()


def test_overlap_counts_repeated_words(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(2)), rng.choice("tu"), rng.choice("xy")) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["query_id"], r["p_partkey"], r["n"]) for r in registry.QUERIES["T8_overlap_preselect"](spark, str(tmp_path)).collect()}
    want = set()
    for q in rows:
        n = [(-sum(x == y for x in [*q[1].split(), *q[2:]] for y in [*p[1].split(), *p[2:]]), p[0]) for p in rows if p[0] != q[0]]
        want |= {(q[0], k, -m) for m, k in sorted(x for x in n if x[0])[:5]}
    assert got == want


def test_names_with_other_beginnings_are_paired(spark, tmp_path):
    import difflib

    names = ["bolt red", "red bolt", "red bolts", "zzz"]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["a"], r["b"]): r["jaccard"] for r in registry.QUERIES["F22_jaccard"](spark, str(tmp_path)).collect()}
    assert got["bolt red", "red bolt"] == round(5 / 9, 8) and ("zzz", "red bolt") not in got
    ratios = {(r["a"], r["b"]): r["ratio"] for r in registry.QUERIES["F23_matching_ratio"](spark, str(tmp_path)).collect()}
    assert ratios == {(a, b): difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a in names for b in names if a < b}


def test_a_mean_at_the_threshold_does_not_hang_on_the_order_of_rows(spark, tmp_path):
    x = [0.01] * 2 + [0.04, 0.05, 0.06, 0.07, 0.05, 0.06, 0.06, 0.07]  # a mean of 0.048
    rows = [(k, flag, v) for k in range(40) for flag in "AN" for v in (x[k % 10 :] + x[: k % 10] if k % 2 else sorted(x, reverse=k % 4 == 0))]
    spark.createDataFrame(rows + [(50, "A", None), (50, "N", 0.1), (51, None, 0.01), (51, "A", 0.1)], "l_suppkey long, l_returnflag string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in registry.QUERIES["F43_adoption_chain"](spark, str(tmp_path)).collect()}
    assert got == {(k, flag, True) for k in range(40) for flag in "AN"} | {(50, "A", False), (50, "N", False), (51, "A", True), (51, None, False)}


def test_the_product_of_two_one_file_tables_is_dealt_over_tasks(spark, tmp_path):
    n, m = 20_000, 3_000
    spark.range(n).selectExpr("id AS p_partkey", "'red gear' AS p_name", "'PROMO' AS p_type", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(m).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    classes = registry.QUERIES["C6_match_classes"](spark, str(tmp_path))
    sizes = [r["n"] for r in classes.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n * m and max(sizes) <= n * m // 4
    assert {r["class"]: r["n"] for r in classes.groupBy("class").agg(F.count("*").alias("n")).collect()} == {"EXACT": n * m // 50, "ATTRIBUTE_DIFFERS": n * m - n * m // 50}


def test_parts_of_equal_words_ask_once(spark, tmp_path, monkeypatch):
    from evidloom.operators import topk

    rows = [(i, "ab cd" if i % 2 else "ab ef", "t", "x") for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    ranked = []
    whole = topk.top_k
    monkeypatch.setattr(topk, "top_k", lambda df, *rest: ranked.append(df.count()) or whole(df, *rest))
    got = {(r["query_id"], r["p_partkey"], r["n"]) for r in registry.QUERIES["T8_overlap_preselect"](spark, str(tmp_path)).collect()}
    assert got == {(i, k, 4) for i in range(300) for k in [k for k in range(i % 2, 14, 2) if k != i][:5]}
    assert max(ranked) <= len(rows)


def test_a_mean_at_the_threshold_falls_where_the_sums_in_table_order_do(spark, tmp_path):
    import random

    import duckdb

    rng, x = random.Random(5), [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.078]  # a mean of 0.048
    rows = [(k, flag, v) for k in range(60) for flag in ("A", "N", None) for v in x * (1 + k % 4)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_discount double").coalesce(1)
    table.write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(registry.ORACLE["F43_adoption_chain"]).fetchall()
    assert {r[2] for r in want} == {True, False}
    assert {tuple(r) for r in registry.QUERIES["F43_adoption_chain"](spark, str(tmp_path)).collect()} == set(want)


def test_the_title_of_every_page_asks_and_equal_titles_once(spark, tmp_path, monkeypatch):
    from evidloom.operators import retrieval

    titles = ["red bolt", "Red bolt", "blue nut", "nothing here", ""]
    pages = [(k, f"<p>x</p><h1>{titles[k % 5]}</h1>") for k in range(1, 60)] + [(60, "no title"), (61, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([("A red bolt. Blue nuts.\na blue nut",), ("the RED one!",), (None,)], "text string").write.parquet(f"{tmp_path}/conversations.parquet")
    asking = []
    monkeypatch.setattr(retrieval, "cut", lambda df, cut=retrieval.cut: asking.append((df.columns, df.count())) or cut(df))
    got = {}
    for r in registry.QUERIES["T8_preselect_rerank"](spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["n"]))
    want = {"red bolt": [("a red bolt", 2), ("the red one", 1)], "blue nut": [("a blue nut", 2), ("blue nuts", 1)]}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(want[titles[k % 5].lower()]) for k in range(1, 60) if k % 5 < 3}
    assert min(n for columns, n in asking if "text" in columns) <= 4


def test_the_product_is_written_in_short_runs(spark, tmp_path):
    """Files must not grow with the width of the right table: its rows come in slices that repeat for one left row after the other."""
    n, m = 40, 30_000
    spark.range(n).selectExpr("id AS p_partkey", "concat_ws('', transform(sequence(1, 2000), k -> sha1(concat(id, '-', k)))) AS p_name", "'PROMO' AS p_type", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(m).selectExpr("xxhash64(id) AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    registry.QUERIES["C6_match_classes"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out.parquet")
    out = spark.read.parquet(f"{tmp_path}/out.parquet")
    assert out.count() == out.select("p_partkey", "s_suppkey").distinct().count() == n * m
    assert sum(f.stat().st_size for f in (tmp_path / "out.parquet").glob("*.parquet")) < n * m
