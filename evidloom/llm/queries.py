"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


WORDS_SQL = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP9_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS sh FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(c, s.doc_id)) AS kept
FROM s LEFT JOIN comp ON s.doc_id = comp.doc_id"""


@query("op9_minhash_near_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), size=2, percent=80)


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import remove_repeats

    out = remove_repeats(documents(spark, sf_dir), length=50)
    removed = F.aggregate(F.zip_with("from_bytes", "to_bytes", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("from_bytes").cast("long").alias("n_spans"), F.sha2("left_bytes", 256).alias("kept_sha256"))


#: A stand-in for a listing feed: the canonical URLs of some pages, by their id, are the listed ones; all pages are judged.
LISTED = "page_id % 37 = 5"

HOST_SQL = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH_SQL = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _fit_sql(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


OP3_SQL = rf"""
WITH p AS (SELECT page_id, {HOST_SQL} AS host, {PATH_SQL} AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') AS u,
  CASE WHEN {_fit_sql("example.net", "/en/")} THEN 'example.net/en/' WHEN {_fit_sql("example.com", "/de/")} THEN 'example.com/de/'
    WHEN {_fit_sql("org", "/fr/")} THEN 'org/fr/' WHEN {_fit_sql("net", "/")} THEN 'net/' END AS rule FROM p),
l AS (SELECT DISTINCT u FROM c WHERE u <> '' AND {LISTED})
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN u IN (SELECT u FROM l) THEN 'block' ELSE 'allow' END AS verdict, u IN (SELECT u FROM l) AS listed FROM c"""


@query("op3_url_filters", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import Rule, canonical, host_of, judge_urls, path_of

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.where(LISTED).select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("url"))
    rules = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
    return judge_urls(pages, listed, rules)


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shuffle_into_shards

    out = shuffle_into_shards(documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .qualityrules import apply_rules

    out = apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "failed_rules")


def held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, out = documents(spark, sf_dir), held_out(5, 0)
    model = toxicity.train(docs.where(~out), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs, out = documents(spark, sf_dir), held_out(4, 2)
    found = langid.classify(docs, langid.train(docs.where(~out)))
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ruleensemble

    docs, out = documents(spark, sf_dir), held_out(4, 2)
    model = ruleensemble.train(docs.where(~out), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out))
    return ruleensemble.score(docs, model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiling import decontaminate

    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents, load_pieces

    docs = documents(spark, sf_dir)
    out = encode_documents(docs.withColumn("text_crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), load_pieces(), keep=("text_crc",))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc")).alias("round_trip"))


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


@query("op11_exact_top_k", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .columnarsearch import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodicruns import longest_run, periodic_runs, with_planted_periods

    out = periodic_runs(with_planted_periods(documents(spark, sf_dir).select("doc_id", "text")), min_length=12)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest_run(F.col("runs")).alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("top")["length"], F.col("top")["period"]
    return out.select("doc_id", "n_runs", F.col("top")["start"].alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)
