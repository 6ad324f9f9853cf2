"""Training-data pipeline over `documents`: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and reread as the next one's docs.  All but the last return the columns
that they were given.  Null ids and null or empty texts pass through the stages
that drop near-duplicates, passages and leaks; the first judges them by their
(empty) statistics.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm import minhash, pieces, ruleensemble, suffixdedup, tiling
from evidloom.llm.runtime import shared_folder, small_batches, without_ids

#: Share of labelled good documents, held out from training, that the first stage may reject.
GOOD_LOSS = 0.005


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble rejects: those below the highest cutoff that loses at most GOOD_LOSS of good ones.

    It learns from three labelled rows of four; the cutoff is set on the fourth, held-out ones.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = ruleensemble.train(docs, labels.where(~held))
    cutoff = ruleensemble.highest_cutoff(docs, labels.where(held), model, GOOD_LOSS)
    # Rows of one id and text share a verdict, so their hash names them and the texts stay out of the result.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    rejected = ruleensemble.score(keyed, model, keep=("key",)).where(F.col("score") < cutoff)
    kept = without_ids(keyed.select("row", "key"), rejected, "key")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of smallest id, of each group of near-duplicates."""
    small_batches(spark)
    found = minhash.near_duplicates(docs, size=5, percent=80)
    return without_ids(docs, found.where(~F.col("kept")))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 bytes and more that an earlier document has; characters that a cut would split go whole."""
    small_batches(spark)
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*others).alias("rest")).alias("row")
    out = suffixdedup.remove_repeats(docs.select("doc_id", "text", row), length=50, keep=("row",), whole_characters=True)
    columns = {c: F.col("row")["rest"][c] for c in others}
    columns["text"] = F.when(~F.col("row")["no_text"], F.col("left_bytes").cast("string"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("from_bytes") > 0, F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, in whatever order of its passages."""
    small_batches(spark)
    found = tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(docs, found.where("contaminated"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_pieces, decoded) of every document."""
    small_batches(spark)
    keep = tuple(c for c in ("lang", "source") if c in docs.columns)
    out = pieces.encode_documents(docs, pieces.load_pieces(), keep=keep)
    return out.select("doc_id", *keep, "ids", F.size("ids").cast("long").alias("n_pieces"), "decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: Near-duplicate candidates, suffix arrays and trained rules are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
