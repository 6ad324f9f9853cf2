"""Operator registry: query name -> Spark function and the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Modules of evidloom.plans that register queries when imported.
MODULES: list[str] = ["projections", "joins", "aggregates", "metrics", "windows", "topk", "sets", "functions", "graphs", "simulation", "compounds", "streams", "sources", "texts", "validation", "whole", "reports", "scopes"]


def query(name: str, sql: str | None = None, instead: bool = False):
    """Register a query under a name, with the SQL that checks it; `instead` of one that holds only some ids."""

    def add(f):
        if (name in QUERIES) != instead:
            raise ValueError(f"query {name} is registered twice, or stands instead of none")
        QUERIES[name] = f
        ORACLE.pop(name, None)
        if sql:
            ORACLE[name] = sql
        return f

    return add


def without(name: str, *cuts: str) -> str:
    """The SQL of a registered query without the given pieces, each of which it must hold."""
    sql = ORACLE[name]
    for c in cuts:
        if c not in sql:
            raise ValueError(f"the SQL of {name} does not hold {c!r}")
        sql = sql.replace(c, "")
    return sql


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"evidloom.plans.{m}")
