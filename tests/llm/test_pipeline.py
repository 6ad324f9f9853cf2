"""The pipeline's stages against brute force, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from evidloom.llm.tiling import greedy_tiles

from .test_minhash import brute_force as near_groups
from .test_suffixdedup import brute_force as repeats
from .test_tiling import brute_force as leaks

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, DATA).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        frames.append(docs)
    return frames


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(stages):
    assert all(df.columns == stages[0].columns and df.dtypes == stages[0].dtypes for df in stages[:-1])


def test_quality_stage_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    gone = stages[0].join(stages[1], "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("quality = 1").count() == 0 and gone.where("quality = 0").count() > 0


def test_near_dedup_stage(stages):
    want = {i for i, (_, _, kept) in near_groups(texts(stages[1]), 5, 80).items() if kept}
    assert {i for i, _ in texts(stages[2])} == want


def test_suffix_stage(stages):
    before = texts(stages[2])
    spans = {i: n for i, n, _, _ in repeats(before, 50)}
    after = dict(texts(stages[3]))
    assert after.keys() == dict(before).keys()
    for i, t in before:
        assert (after[i] == t) == (spans[i] == 0)
    sizes = stages[3].where("text is not null").select(F.length("text") == F.col("n_chars")).distinct().collect()
    assert [r[0] for r in sizes] == [True]


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = leaks(texts(stages[3]), items, 5, 0.8, greedy_tiles)  # which test_tiling holds against all places; those would take long here
    assert {i for i, _ in texts(stages[4])} == {i for i, _ in texts(stages[3])} - set(want)


def test_encoding_stage_decodes_to_the_text(stages):
    after = {r["doc_id"]: r for r in stages[5].collect()}
    for i, t in texts(stages[4]):
        assert after[i]["decoded"] == (t or "").replace("▁", " ") and after[i]["n_pieces"] == len(after[i]["ids"])


def test_run_is_the_stages(spark, stages):
    assert sorted(r["doc_id"] for r in cp.run(spark, DATA).select("doc_id").collect()) == sorted(r["doc_id"] for r in stages[-1].select("doc_id").collect())


def test_clashing_names_keep_their_values(spark):
    body = "a passage of words that both documents share, longer than fifty bytes"
    rows = [(i, f"{w} {body} {w} own words", "v", True, f"c{i}", "x", "y", 5) for i, w in enumerate(("first", "second"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, no_text boolean, cut string, row string, rest string, n_chars int")
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        for r in out.collect():
            assert (r["key"], r["no_text"], r["cut"], r["row"], r["rest"]) == ("v", True, f"c{r['doc_id']}", "x", "y")
    assert stage is cp.benchmark_decontamination
    assert cp.sentencepiece_encoding(spark, docs.limit(0), DATA).collect() == [] and cp.quality_classifier(spark, docs.limit(0), DATA).collect() == []


def test_quality_stage_rejects_most_bad_documents(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    kept = cp.quality_classifier(spark, docs, data).select("doc_id", F.lit(1).alias("kept"))
    share = {r["quality"]: r["s"] for r in labels.where("quality is not null").join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("s")).collect()}
    assert share[1] >= 0.98 and share[0] <= 0.2


def test_odd_rows_pass_through(spark, tmp_path_factory):
    rows = [(None, None, None, None, None, "x"), (None, "text of no id", "en", "a", 13, "x"), (1, None, "en", "a", 0, None), (2, "", "en", "a", 0, None), (2, "", "en", "a", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    labels = spark.createDataFrame([], "doc_id long, quality int")  # without labels the first stage rejects nothing
    labels.write.parquet(str(folder := tmp_path_factory.mktemp("odd") / "labels.parquet"))
    first = cp.quality_classifier(spark, docs, str(folder.parent))
    assert first.columns == docs.columns and first.count() == len(rows)
    for _, stage in cp.STAGES[1:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() == len(rows)
        assert stage(spark, docs.limit(0), DATA).collect() == []
    assert cp.sentencepiece_encoding(spark, docs, DATA).count() == len(rows)
