"""Connected components of an edge table: union-find inside tasks, star rounds between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import salted_join, shared


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one task's edges, a bounded number at a time; each node then points at its root."""
    parent: dict = {}
    kind = None

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        rows = [(x, r) for x in parent if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], kind), pa.array([r for _, r in rows], kind)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema[0].type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield out()
            parent.clear()
    if parent:
        yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge.

    Nodes are numbers or strings.  Edges are contracted by union-find inside each
    task, then large-star and small-star rounds run until nothing changes.
    Rounds grow with the logarithm of the longest path; the edges of a hot node
    are salted.  Null ends and self loops are ignored; repeated edges count once;
    an empty table gives an empty result; other columns are ignored.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    kind = e.schema["a"].dataType.simpleString()
    e = shared(e.mapInArrow(_contract, f"a {kind}, b {kind}").distinct())
    last, n = None, e.count()
    while True:
        # Large star: each node's larger neighbours go to the smallest of its neighbourhood.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = shared(salted_join(both.where("b > a"), low, "a", "n", ["b"], total=2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: each node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, low, "a", "n", ["b"], total=n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = shared(small.where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last, n = now, now[0]
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
