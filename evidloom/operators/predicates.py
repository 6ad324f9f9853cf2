"""Predicates and guards as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns; an allowed column that is missing is an error, so that a renamed input is noticed."""
    if missing := [c for c in allowed if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*allowed)


def code_classes(version: Column, code: Column, table: list[tuple[str, int, str]]) -> Column:
    """All classes (name, version, pattern) that a code falls in, in the table's order."""
    return F.array_compact(F.array(*[F.when((version == v) & code.rlike(p), F.lit(name)) for name, v, p in table]))


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    return reduce(lambda out, r: F.when(r[0], F.lit(r[1])).otherwise(out), reversed(rules), F.lit(default))


def all_reasons(rules: dict[str, Column]) -> Column:
    """The names of all conditions that hold; a null condition does not."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def in_range(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.between(lo, hi), x)
