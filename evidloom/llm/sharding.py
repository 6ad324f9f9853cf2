"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in sources, by a hash of the row and of its number among equal rows; so
a recomputed task finds the same rows, and no source is filled by copies of one.
The number of rows that each source sends to each shard is drawn first, from the
law that a uniform permutation of all rows would give: source by source, a
multivariate hypergeometric draw from what the shards still have room for.  Each
source then permutes its rows and deals them out by these counts, and each shard
permutes what it has received.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, shared

#: Populations from which the generator draws directly, and rows that are drawn one by one at a time beyond.
_DIRECT, _BLOCK = 1_000_000_000, 1 << 20


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from each source to each shard; shard totals differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = np.full(shards, total // shards, dtype=np.int64)
    room[: total % shards] += 1
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        out[p] = draw(rng, room, n)
        room -= out[p]
    return out


def draw(rng: np.random.Generator, room: np.ndarray, n: int, direct: int = _DIRECT) -> np.ndarray:
    """How many of n places, drawn without return from all that there is room for, fall to each shard; exact at any size."""
    out, left = np.zeros_like(room), room.copy()
    while n:
        total = int(left.sum())
        if n >= total:
            return out + left
        if total < direct:
            return out + rng.multivariate_hypergeometric(left, n, method="marginals")
        take = min(n, _BLOCK, total // 2)
        part = np.bincount(np.searchsorted(np.cumsum(left), _distinct(rng, total, take), side="right"), minlength=len(room))
        out, left, n = out + part, left - part, n - take
    return out


def _distinct(rng: np.random.Generator, below: int, n: int) -> np.ndarray:
    """n different numbers below the bound: the first different ones of a sequence of draws."""
    held = np.empty(0, np.int64)
    while len(held) < n:
        held = np.concatenate([held, rng.integers(0, below, n)])
        held = held[np.sort(np.unique(held, return_index=True)[1])]
    return held[:n]


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = 20240607, rows_per_run: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; shards hold equal row counts, one apart at most.

    size is the UTF-8 length of the text (null: 0) plus 16; text_crc32 is null for
    a null text's missing bytes read as empty (0).  Slots count from 0 in each
    shard without gaps.  Null ids form rows like any other; repeated rows stay
    apart and are dealt each on its own; other columns are ignored; very long
    texts count by their size only; an empty table gives an empty result.  The
    outcome depends on the rows and the seed, not on how they are partitioned.
    What passes through the driver is one count for each source and shard; there
    is a source for every `rows_per_run` rows, and no task orders more than about that many.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # Equal rows are numbered by counting them, in stretches, so that many copies of one row are no single task's.
    names = ["doc_id", "size", "text_crc32"]
    groups = shared(rows.groupBy(*names).agg(F.count("*").alias("n")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sources = max(64, -(-total // rows_per_run))
    few = groups.where(F.col("n") <= rows_per_run).select(*names, F.lit(0).cast("long").alias("base"), "n")
    many = groups.where(F.col("n") > rows_per_run).select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows_per_run).cast("long"))).alias("base"), "n").repartition(*names, "base")
    each = few.unionByName(many).select(*names, F.explode(F.sequence("base", F.least(F.col("base") + rows_per_run, F.col("n")) - 1)).alias("at"))
    mixed = F.xxhash64(F.lit(seed), *names, "at")
    rows = each.select(*names, "at", F.pmod(F.xxhash64(F.lit(seed + 1), mixed), F.lit(sources)).cast("int").alias("source"), mixed.alias("first_key"), F.xxhash64(F.lit(seed + 2), mixed).alias("second_key"))
    have = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    bounds = np.cumsum(communication_matrix([have.get(p, 0) for p in range(sources)], shards, seed), axis=1)
    table = rows.sparkSession.createDataFrame([(p, b.tolist()) for p, b in enumerate(bounds)], "source int, bounds array<long>")
    hint = F.broadcast if sources * shards <= BROADCAST_ROWS else lambda df: df
    local = Window.partitionBy("source").orderBy("first_key", *names, "at")
    dealt = rows.withColumn("place", F.row_number().over(local)).join(hint(table), "source")
    dealt = dealt.select(*names, "at", "second_key", F.size(F.filter("bounds", lambda b: b < F.col("place"))).alias("shard"))
    # The second permutation: by runs of the key's range, so that no task orders a whole shard.
    runs = max(1, -(-total // (shards * rows_per_run)))
    dealt = shared(dealt.withColumn("run", F.pmod(F.shiftrightunsigned("second_key", 1), F.lit(runs))))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    hint = F.broadcast if runs * shards <= BROADCAST_ROWS else lambda df: df
    within = Window.partitionBy("shard", "run").orderBy("second_key", *names, "at")
    out = dealt.withColumn("place", F.row_number().over(within)).join(hint(start), ["shard", "run"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"))
