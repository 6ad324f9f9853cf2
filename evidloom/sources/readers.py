"""Readers of the delimited, nested and flat-file formats; every read declares its schema."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """CSV with a header; only the named columns are parsed."""
    df = spark.read.schema(schema).options(header=True, **options).csv(path)
    return df.select(*columns) if columns else df


def all_strings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """CSV as strings, in which a missing value is the empty string."""
    return csv(spark, path, ", ".join(f"`{n}` string" for n in names)).na.fill("")


def tsv(spark: SparkSession, path: str, schema: str, comment: str = "#") -> DataFrame:
    """Tab-separated lines; comment lines, which may hold the header, are left out."""
    return spark.read.schema(schema).options(sep="\t", comment=comment, header=False).csv(path)


def piped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines split at |, in which quotes mean nothing."""
    return spark.read.schema(schema).options(sep="|", quote="", header=False).csv(path)


def keyed_lines(spark: SparkSession, path: str, keys: DataFrame, key: str, fields: dict[str, int], separator: str = "|") -> DataFrame:
    """Fields of the lines of which one of two key fields (the first two in `fields`) is in keys."""
    parts = F.split("value", "\\" + separator)
    df = spark.read.text(path).select(*[F.get(parts, F.lit(k)).alias(n) for n, k in fields.items()])
    first, second = list(fields)[:2]
    known = keys.select(F.col(key)).distinct()
    by_first = df.join(known.withColumnRenamed(key, first), first, "left_semi")
    by_second = df.join(known.withColumnRenamed(key, second), second, "left_semi")
    # A line with both keys counts once.
    return by_first.unionByName(by_second.join(known.withColumnRenamed(key, first), first, "left_anti"))


def catalog(spark: SparkSession, path: str, excluded: list[str]) -> DataFrame:
    """A JSON dictionary of questions as one row each, with parent (null for roots)."""
    entry = "struct<name:string,question_en:string,data_type:string,code_question:string,is_antecedent:boolean,possible_values:array<string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("code", "q"))
    out = raw.where(~F.col("code").isin(excluded)).select("code", "q.*")
    return out.withColumn("parent", F.when(F.col("code_question") != F.col("code"), F.col("code_question"))).drop("code_question", "name")


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines without repeats of a key."""
    rows = spark.read.schema(schema).json(path)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")


def stanzas(spark: SparkSession, path: str, kind: str = "Term") -> DataFrame:
    """(id, name, parents, synonyms, obsolete) of the stanzas of an OBO file."""
    text = spark.read.option("lineSep", "\n\n").text(path).select("value").where(F.col("value").rlike(rf"(?m)^\[{kind}\]"))
    one = lambda tag: F.nullif(F.regexp_extract("value", rf"(?m)^{tag}: (.*)$", 1), F.lit(""))
    many = lambda tag, what: F.regexp_extract_all("value", F.lit(rf"(?m)^{tag}: {what}"), F.lit(1))
    return text.select(one("id").alias("id"), one("name").alias("name"), many("is_a", r"(\S+)").alias("parents"), many("synonym", r'"([^"]*)"').alias("synonyms"), (F.coalesce(one("is_obsolete"), F.lit("")) == "true").alias("obsolete"))


def tagged_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(document, tokens, tags) of a token-per-line file with a blank line between documents."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''").withColumn("document", F.monotonically_increasing_id())
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return blocks.select("document", F.transform(lines, lambda x: F.substring_index(x, "\t", 1)).alias("tokens"), F.transform(lines, lambda x: F.substring_index(x, "\t", -1)).alias("tags"))


def yaml_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """(name, section, item) of small nested documents: `section:` lines with `- name: item` entries below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["value"]:
                name, section = None, None
                for line in text.splitlines():
                    if line.startswith("name:"):
                        name = line[5:].strip()
                    elif line and not line[0].isspace() and line.rstrip().endswith(":"):
                        section = line.rstrip()[:-1]
                    elif line.strip().startswith("- name:") and section:
                        rows.append((name, section, line.strip()[7:].strip()))
            yield pd.DataFrame(rows, columns=["name", "section", "item"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "name string, section string, item string")


def active_rows(df: DataFrame, kinds: list[str] | None = None, kind: str = "typeId") -> DataFrame:
    """Active rows of a release table, of the named kinds."""
    out = df.where(F.col("active") == "1")
    return out.where(F.col(kind).isin(kinds)) if kinds else out


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at a path; no file is opened."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = store.listFiles(root, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:32]


def stamped(spark: SparkSession, path: str, cache: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build(the table at path), kept in a folder of its own under the stamp of the table's files.

    While the files stay as they are, the table isn't read again.  When they have
    changed it is built anew, and what was kept under older stamps goes.
    """
    own = f"{cache}/{stamp(spark, path)}"
    root = spark._jvm.org.apache.hadoop.fs.Path(cache)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{own}/_SUCCESS")):
        build(spark.read.parquet(path)).write.mode("overwrite").parquet(own)
        for other in store.listStatus(root):
            if other.getPath().getName() != own.rpartition("/")[2]:
                store.delete(other.getPath(), True)
    return spark.read.parquet(own)
