"""Text statistics against plain Python, exact bounds, and the learned classifiers' held-out quality."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidloom.llm import langid, queries, ruleensemble, toxicity
from evidloom.llm import qualityrules
from evidloom.llm.qualityrules import apply_rules, at_most, upper_bound
from evidloom.llm.textstats import with_statistics

DATA = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"  # where the held-out toxic texts are enough to tell a rate


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for k in range(len(words) - 7):
        at.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics(spark):
    rng = random.Random(2)
    pool = ["a", "é漢", "b#", "\n", "\n\n", " \n", "word", "\t", "$%", "a b c d e f g h\n"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 90)))) for i in range(150)] + [(900, None), (901, ""), (902, "x " * 30), (None, "a")]
    out = with_statistics(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(texts[r["doc_id"]])


@pytest.mark.parametrize(("k", "n", "alpha"), [(0, 50, 0.05), (3, 100, 0.01), (10, 10, 0.05), (40, 200, 0.001)])
def test_exact_upper_bound(k, n, alpha):
    p = upper_bound(k, n, alpha)
    if k < n:
        at_most = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(at_most - alpha) < 1e-6
    else:
        assert p == 1.0


def test_bounds_of_large_counts_are_quick():
    from fractions import Fraction

    for k, n, p in [(0, 1, 0.5), (5, 12, 0.3), (30, 400, 0.1), (399, 400, 0.99), (200, 400, 0.5)]:
        q = Fraction(p)
        exact = float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
        assert math.isclose(at_most(k, n, p), exact, rel_tol=1e-9)
    assert 0.4 < at_most(200_000, 1_000_000, 0.2) < 0.6
    assert 0.2 < upper_bound(200_000, 1_000_000, 1e-4) < 0.202


def test_cutoffs_and_verdicts_against_brute_force(spark):
    """Cutoffs from exact fractions over the labelled good texts, and the verdict of every row."""
    from fractions import Fraction

    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(["plain", "word", "text", "a", "longer"]) + str(rng.randrange(10**6)) for _ in range(rng.randint(22, 60))]
        if i % 9 == 0:
            words += ["###", "#$%"] * (i % 30)
        rows.append((i, "\n".join(" ".join(words[k : k + 9]) + "." for k in range(0, len(words), 9)), "x", 1))
        labels.append((i, int(i % 9 != 0)))
    rows += [(900, None, None, 0), (901, "", None, 0), (5, rows[5][1], "twice", 2), (None, rows[6][1], None, 3)]
    labels += [(5, 1), (6, 0), (None, 1), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stratum string, n_words int")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    risk, delta = 0.2, 0.05
    out = apply_rules(docs, known, risk, delta).collect()
    stats = with_statistics(docs).selectExpr("*", *[f"coalesce({e}, 0.0) AS r_{r}" for r, e in qualityrules.RATIOS.items()]).collect()
    worst = {}
    for i, q in labels:
        if i is not None and q is not None:
            worst[i] = min(q, worst.get(i, 1))
    base = lambda r: r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
    stratum = lambda r: sum(r["n_words"] >= s for s in qualityrules.STRATA)
    good = [r for r in stats if worst.get(r["doc_id"]) == 1 and not base(r)]
    tests = sum(map(len, qualityrules.GRIDS.values())) * (len(qualityrules.STRATA) + 1)
    p, cutoffs = Fraction(risk / len(qualityrules.GRIDS)), {}
    for s in range(len(qualityrules.STRATA) + 1):
        mine = [r for r in good if stratum(r) == s]
        for rule, grid in qualityrules.GRIDS.items():
            for c in sorted(grid, reverse=True):
                k, n = sum(r[f"r_{rule}"] > c for r in mine), len(mine)
                if n and k < n and sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) <= delta / tests:
                    cutoffs[rule, s] = min(c, cutoffs.get((rule, s), c))
    assert cutoffs
    want = sorted(((r["doc_id"], not base(r) and not any(s == stratum(r) and r[f"r_{rule}"] > c for (rule, s), c in cutoffs.items())) for r in stats), key=str)
    assert sorted(((r["doc_id"], r["kept"]) for r in out), key=str) == want and {k for _, k in want} == {True, False}


def test_training_does_not_depend_on_partitions(spark):
    rng = random.Random(8)
    docs = [(i % 150, " ".join(rng.choice(["good", "text", "vile", "x", "slur"]) + str(rng.randrange(40)) for _ in range(30)), "s", 0) for i in range(300)] + [(160, "long " * 200_000, None, 1)]
    labels = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(160)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    make = lambda n: spark.createDataFrame(docs, "doc_id long, text string, score string, words int").repartition(n)
    for m in (ruleensemble, toxicity):
        a, b = m.train(make(2), known), m.train(make(7), known)
        scored = m.score(make(3), a).collect()
        assert len(scored) == len(docs) and sorted((r["doc_id"], round(r["score"], 9)) for r in scored) == sorted((r["doc_id"], round(r["score"], 9)) for r in m.score(make(3), b).collect())


def test_language_training_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "the cat and the dog " * 4, "en", "x")] * 3 + [(2, "le chien et la maison " * 4, "fr", "y"), (None, None, "zz", "z"), (3, "x" * 9, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string")
    assert langid.train(df) == {"en": rows[0][1].strip().encode(), "fr": rows[3][1].strip().encode()}
    assert langid.train(df.limit(0)) == {} and langid.classify(df.limit(0), {"en": b"the"}).collect() == []
    assert len(langid.classify(df, langid.train(df)).collect()) == len(rows)


def test_rules_keep_good_texts(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = apply_rules(docs, labels).join(labels, "doc_id")
    good = out.where("quality = 1 and not base_failed").agg(F.avg((~F.col("kept")).cast("int"))).first()[0]
    assert good <= 0.05
    bare = apply_rules(docs.limit(20), labels.limit(0))
    assert bare.where("not base_failed and not kept").count() == 0 and apply_rules(docs.limit(0), labels).collect() == []


def accuracy(spark, name, label, data=DATA):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    out = queries.QUERIES[name](spark, data)
    assert out.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert out.where("score is null or score < 0 or score > 1 or predicted is null").count() == 0
    held = out.where("held_out").join(labels, "doc_id")
    return held.groupBy(label).agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("a")).collect()


def test_quality_classifier_held_out(spark):
    assert all(r["a"] > 0.9 for r in accuracy(spark, "op8_quality_classifier", "quality"))


def test_toxicity_held_out(spark):
    assert all(r["a"] > 0.8 for r in accuracy(spark, "op1_toxicity", "toxic", LARGE))


def test_language_held_out(spark):
    out = queries.QUERIES["op7_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (None, "the onesen", "x")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.classify(odd, {"en": b"the and of", "fr": b"le la des"}).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] in ("en", "fr")
    assert [r["lang_pred"] for r in langid.classify(odd, {}).collect()] == ["und"] * 4


def test_models_of_no_or_one_class(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    for labels in (spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")):
        for m in (ruleensemble, toxicity):
            out = m.score(docs, m.train(docs, labels)).collect()
            assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert ruleensemble.score(docs.limit(0), ruleensemble.train(docs.limit(0), labels)).collect() == []


def test_rules_from_one_split():
    x = np.array([[0.1], [0.9]] * 50)
    model = ruleensemble.fit_rules(x, np.array([0.0, 1.0] * 50))
    assert model.rules and all(c[0] == 0 for r, _ in model.rules for c in r)


def test_held_out_column(spark):
    out = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", queries.held_out(5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def test_languages_of_long_or_short_texts_are_learned(spark):
    rows = [(i, "the cat and the dog of the house " * 4, "en") for i in range(3)] + [(9, "der hund und die katze aus dem haus " * 200, "de"), (10, "le chien et la maison", "fr"), (11, "123", "xx")]
    dictionaries = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(dictionaries) == ["en", "de", "fr"] and len(dictionaries["de"]) > 4096
    whole = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dictionary_bytes=10)
    assert whole["en"] == rows[0][1].strip().encode()  # texts are not cut
    odd = spark.createDataFrame([(1, "die katze und der hund"), (2, "la maison et le chien")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.classify(odd, dictionaries).collect()} == {1: "de", 2: "fr"}


def test_a_repeated_id_is_learned_from_its_smallest_features(spark):
    rows = [(i, "word " * (5 + i % 40)) for i in range(200)]
    docs = spark.createDataFrame(rows + [(i, "many more words " * 60) for i in range(0, 200, 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 40 > 20)) for i in range(200)], "doc_id long, quality int")
    once = ruleensemble.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert once.rules
    assert ruleensemble.train(docs, labels) == once == ruleensemble.train(docs.orderBy(F.desc("doc_id")).repartition(3), labels.union(labels))


def test_cutoff_counts_every_labelled_good_text(spark):
    n = 24_000
    # The few worst texts have the last hashes, so a sample by hash leaves them out.
    last = [r["id"] for r in spark.range(n).orderBy(F.xxhash64("id").desc()).limit(3).collect()]
    words = lambda i: 1 + last.index(i) if i in last else 5 + i % 7
    docs = spark.createDataFrame([(i, " ".join(["word"] * words(i))) for i in range(n)] + [(n, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(n)] + [(n, 0), (None, 1), (n + 1, 1)], "doc_id long, quality int")
    model = ruleensemble.RuleModel(0.0, [(((0, False, float(w)),), -0.5) for w in range(1, 12)])
    want = sorted(1 / (1 + math.exp(0.5 * sum(words(i) <= w for w in range(1, 12)))) for i in range(n))
    for rank in (0, 1, 2, 3, 5_000, n - 1):
        assert ruleensemble.highest_cutoff(docs, labels, model, (rank + 0.5) / n) == pytest.approx(want[rank], abs=1e-12)
    assert ruleensemble.highest_cutoff(docs, labels.where("quality = 0"), model) == 0.0
