"""Ordering, limits and choices per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def rounded_argmax(df: DataFrame, keys: list[str], score: str, tie: Column, name: str, digits: int = 12) -> DataFrame:
    """(keys, name, score): the largest score after rounding, then the smallest tie value."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(F.col(name), F.col(score)), F.struct(F.round(score, digits), -tie)).alias("_b")).select(*keys, f"_b.{name}", f"_b.{score}")


def smallest_within(df: DataFrame, keys: list[str], parameter: str, score: str, tolerance: float) -> DataFrame:
    """(keys, parameter): the smallest parameter whose score is within the tolerance of the best."""
    best = df.groupBy(*keys).agg(F.max(score).alias("_best"))
    return df.join(best, keys).where(F.col(score) >= F.col("_best") - tolerance).groupBy(*keys).agg(F.min(parameter).alias(parameter))


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows of smallest SHA-256 of a key, so that every run takes the same ones."""
    return df.orderBy(F.sha2(key, 256), key).limit(n)


def interleaved(left: DataFrame, right: DataFrame, keys: list[str], item: str, place: str) -> DataFrame:
    """(keys, item, place): two ranked lists merged in turn, left first; the first place of an item counts."""
    both = left.select(*keys, item, (F.col(place) * 2).alias("_p")).unionByName(right.select(*keys, item, (F.col(place) * 2 + 1).alias("_p")))
    first = both.groupBy(*keys, item).agg(F.min("_p").alias("_p"))
    return first.select(*keys, item, F.row_number().over(Window.partitionBy(*keys).orderBy("_p")).alias(place))
