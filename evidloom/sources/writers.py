"""Sinks: delimited, columnar and JSON files, indexes, sealed outputs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one file only for small results."""
    (df.coalesce(1) if one_file else df).write.mode("errorifexists").options(header=True, lineSep="\n").csv(path)


def csv_or_empty(df: DataFrame, path: str) -> None:
    """As csv; a table without rows is written as status,EMPTY."""
    csv(df.sparkSession.createDataFrame([("EMPTY",)], "status string") if df.isEmpty() else df, path)


def parquet(df: DataFrame, path: str, rows_per_file: int = 0, by: list[str] | None = None) -> None:
    """Parquet, with at most so many rows a file, partitioned by columns of few values."""
    w = df.write.mode("errorifexists")
    w = w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w
    (w.partitionBy(*by) if by else w).parquet(path)


def json_summary(df: DataFrame, path: str) -> None:
    """One JSON object a row, with sorted keys."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)


def index(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """A table bucketed and sorted by its lookup keys, so that joins on them need no exchange."""
    df.write.mode("errorifexists").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def sealed(public: DataFrame, secret: DataFrame, path: str) -> DataFrame:
    """Public and sealed outputs in two folders, never over an existing one; returns (part, n, digest) of their rows."""
    parquet(public, f"{path}/public")
    parquet(secret, f"{path}/sealed")
    return digest(public).withColumn("part", F.lit("public")).unionByName(digest(secret).withColumn("part", F.lit("sealed")))


def digest(df: DataFrame) -> DataFrame:
    """(n, digest): row count and an order-free sum of row hashes."""
    return df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))


def append_log(df: DataFrame, path: str) -> None:
    """Appends status rows; a batch is visible whole or not at all."""
    df.write.mode("append").parquet(path)
