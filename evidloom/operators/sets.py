"""Unions, differences, duplicates and merges of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_union(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Bag union by name with the part's name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): MISSING where only left has it, EXTRA where only right has it; one grouped pass over both."""
    both = left.select(key, F.lit(1).alias("_s")).unionByName(right.select(key, F.lit(2).alias("_s")))
    seen = both.groupBy(key).agg(F.bit_or("_s").alias("_s")).where("_s < 3")
    return seen.select(key, F.when(F.col("_s") == 1, "MISSING").otherwise("EXTRA").alias("side"))


def partition_faults(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, n_splits) of keys that are in several splits."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def without_conflicts(df: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """The first row of each key whose rows agree on the status; keys in conflict go wholly."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r"), F.count_distinct(status).alias("_n")).where("_n = 1")
    return best.select(key, "_r.*")


def merged(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing and those incoming rows whose key is new."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti"))


def upserted(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """incoming and those existing rows that it does not replace."""
    return merged(incoming, existing, key)
