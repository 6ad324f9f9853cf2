"""Vector index: exact form against brute force, recall of the inverted lists."""

import os

import numpy as np

from evidloom.operators import vectors as V
from evidloom.plans.fixtures import table
from pyspark.sql import functions as F

DATA = os.environ.get("EVIDLOOM_TEST_VECTORS", "/root/testdata/sf0.1")


def brute(rows, asked, k):
    unit = {i: (lab, np.array(v, float) / np.linalg.norm(v)) for i, v, lab in rows if v is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) and len(v) == 3}
    out = set()
    for q in asked:
        if q not in unit:
            continue
        best = {}
        for i, (lab, u) in unit.items():
            if i != q:
                best[lab] = min(best.get(lab, (9, 0)), (-round(float(unit[q][1] @ u), 6), i))
        first = sorted(best.items(), key=lambda x: (x[1][0], x[0] is not None, x[0]))[:k]
        out |= {(q, i, lab, -s) for lab, (s, i) in first}
    return out


def rows_of(df):
    return {(r["query_id"], r["id"], r["label"], r["cosine"]) for r in df.collect()}


def test_exact_form_equals_all_pairs_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 7)
    monkeypatch.setattr(V, "QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)], int(rng.integers(0, 5)) if i % 9 else None) for i in range(90)]
    rows += [(90, None, 1), (91, [1.0, None, 2.0], 1), (92, [float("nan"), 1.0, 1.0], 2), (93, [0.0, 0.0, 0.0], 2), (94, [1.0], 3), (95, [], 3), (100, [1.0, 1.0, 1.0], 4), (105, [2.0, 2.0, 2.0], 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").withColumn("u", F.lit("clash")).withColumn("list", F.lit(1))
    got = rows_of(V.nearest_by_cosine(df, "id", "v", "label", F.col("id") % 5 == 0, 3))
    assert got == brute(rows, range(0, 110, 5), 3)
    # All lists probed: the index gives the same.
    assert rows_of(V.nearest_by_cosine(df, "id", "v", "label", F.col("id") % 5 == 0, 3, centres=6, recall=1.0, sample=1000)) == got


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1)], "id long, v array<double>, label int")
    for centres in (0, 4):
        assert V.nearest_by_cosine(df.limit(0), "id", "v", "label", F.col("id") == 1, 3, centres=centres).count() == 0
        assert V.nearest_by_cosine(df, "id", "v", "label", F.col("id") == 1, 3, centres=centres).count() == 0


def test_recall_of_the_index_at_ten(spark):
    """Every row a label of its own: the ten nearest of each query with an id divisible by 20, against all rows."""
    e = table(spark, DATA, "embeddings").withColumn("own", F.col("vec_id"))
    held = V.sample_of(V.unit_vectors(e, "vec_id", "embedding", "own"), 20_000)
    centres = V.fit_centres(held, 64)
    assert V.probes_for(held, centres, 10, 0.95) < len(centres)
    ask = F.col("vec_id") % 20 == 0
    exact = {(q, i) for q, i, *_ in rows_of(V.nearest_by_cosine(e, "vec_id", "embedding", "own", ask, 10))}
    found = {(q, i) for q, i, *_ in rows_of(V.nearest_by_cosine(e, "vec_id", "embedding", "own", ask, 10, centres=64))}
    assert len(exact) == 10 * e.where(ask).count() == len(found)
    assert len(exact & found) >= 0.9 * len(exact)
