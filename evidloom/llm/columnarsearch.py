"""Exact top-k search by inner product: columnar branch-and-bound over dimension blocks.

Vectors are whole numbers and lie in blocks of rows, dimension by dimension
(vertical layout).  A block of queries meets a block of rows by adding up one
block of dimensions after another; what the rest can still add is bounded by the
product of the remaining masses (Cauchy-Schwarz), so pairs that can no longer
reach a query's k-th best score leave, and the survivors are compacted.  The
dimensions of most mass come first.

Queries and rows meet in a grid: rows are dealt to `r` groups, queries to `c`,
and each of the r x c cells is one key of an equi-join of blocks.  A cell holds
at most CELL_BLOCKS query blocks, so a task's memory doesn't grow with the data,
and hands on the k best of each query only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import partitions, shared, small_batches

#: Rows of a block, queries of a block, query blocks of a cell, dimensions of a step.
ROWS, QUERIES, CELL_BLOCKS, STEP = 2048, 256, 64, 8
#: Whole components beyond this are cut to it, so that scores of up to 2**18 dimensions fit a long.
LARGEST = 1 << 22
#: Rows that give each query a first lower bound; they only prune.
SEEDS = 1024
_LEAST = -(1 << 63)
#: Share of pairs from which on they are kept as a list.
_SPARSE = 0.2


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * component), of rows with an id and with finite components only."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return rows.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, rows x dimensions) of a batch's vectors v, by their length."""
    column = batch.column("v")
    begin = column.offsets.to_numpy()
    lengths, values = np.diff(begin), column.values.to_numpy()
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, values[begin[at][:, None] + np.arange(d)].astype(np.int64)


def rests(m: np.ndarray) -> np.ndarray:
    """Root of the mass from each step's first dimension on, for the columns of a (dimensions x rows) matrix, a little too large rather than too small."""
    mass = np.add.accumulate((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
    return np.sqrt(np.vstack([mass[::STEP], np.zeros((1, m.shape[1]))])) * (1 + 1e-9)


def survivors(q: np.ndarray, c: np.ndarray, q_rest: np.ndarray, c_rest: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs whose score is at least the query's floor.

    q and c are (dimensions x queries) and (dimensions x rows).  Sums are exact:
    doubles hold them where they stay below 2**53, else longs do.
    """
    d = c.shape[0]
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * d < 1 << 52
    kind = np.float64 if exact else np.int64
    q, c, least = q.astype(kind), c.astype(kind), floor.astype(np.float64)
    off = 0.0 if exact else 1e-9  # longs are compared as doubles
    score, pairs, at, k = np.zeros((q.shape[1], c.shape[1]), kind), None, 0, 0
    while at < d:
        to, k = min(at + STEP, d), k + 1
        if pairs is None:
            score += q[at:to].T @ c[at:to]
            may = score + q_rest[k][:, None] * c_rest[k] + off * np.abs(score) >= least[:, None] - 1
            if (n := np.count_nonzero(may)) < _SPARSE * may.size or to == d:
                pairs, score = (found := np.nonzero(may)), score[found]
        else:
            a, b = pairs
            for j in range(at, to):
                score += q[j][a] * c[j][b]
            may = score + q_rest[k][a] * c_rest[k][b] + off * np.abs(score) >= least[a] - 1
            pairs, score = (a[may], b[may]), score[may]
        if pairs is not None and not len(score):
            break
        at = to
    a, b = np.nonzero(np.ones_like(score, bool)) if pairs is None else pairs
    score = score.ravel().astype(np.int64) if pairs is None else score.astype(np.int64)
    good = score >= floor[a]
    return a[good], b[good], score[good]


class _Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.floor, self.k = ids, floor.copy(), k
        self.query, self.found, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        other = found != self.ids[query]
        query, found, score = (np.concatenate([x, y[other]]) for x, y in ((self.query, query), (self.found, found), (self.score, score)))
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        last = rank == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        self.query, self.found, self.score = query[top], found[top], score[top]


def _blocks(batch: pa.RecordBatch, size: int, orders: dict[int, np.ndarray], columns: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(columns, rows x dimensions) of each block of vectors of one length."""
    for at, m in matrices(batch):
        m = m[:, orders[m.shape[1]]] if m.shape[1] in orders else m
        for lo in range(0, len(at), size):
            yield {c: batch.column(c).to_numpy()[at[lo : lo + size]] for c in columns}, m[lo : lo + size]


def _packed(m: np.ndarray, **longs: np.ndarray) -> pa.RecordBatch:
    """One row: the number of dimensions, the vectors dimension by dimension, and columns of longs."""
    cells = {"d": pa.array([m.shape[1]], pa.int32()), "v": pa.array([np.ascontiguousarray(m.T.astype(np.int32)).tobytes()], pa.binary())}
    cells |= {c: pa.array([x.astype(np.int64).tobytes()], pa.binary()) for c, x in longs.items()}
    return pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))


def _unpacked(v: pa.Scalar, dims: int) -> np.ndarray:
    m = np.frombuffer(v.as_buffer(), np.int32)
    return m.reshape(dims, len(m) // max(1, dims)).astype(np.int64)


def row_blocks(vectors: DataFrame, orders: dict[int, np.ndarray]) -> DataFrame:
    """(d, v, ids): blocks of up to ROWS vectors of one length, in vertical layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, m in _blocks(batch, ROWS, orders, ("id",)):
                yield _packed(m, ids=names["id"])

    return vectors.mapInArrow(run, "d int, v binary, ids binary")


def query_blocks(queries: DataFrame, seeds: dict[int, tuple[np.ndarray, np.ndarray]], orders: dict[int, np.ndarray], k: int) -> DataFrame:
    """(d, q, q_ids, q_keys, q_floor): blocks of queries, with the k-th best score that each has among the seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, m in _blocks(batch, QUERIES, orders, ("id", "key")):
                best = _Best(names["id"], np.full(len(m), _LEAST, np.int64), k)
                if m.shape[1] in seeds:
                    found, rows = seeds[m.shape[1]]
                    a, b, score = survivors(m.T, rows.T, rests(m.T), rests(rows.T), best.floor)
                    best.add(a, found[b], score)
                yield _packed(m, q_ids=names["id"], q_keys=names["key"], q_floor=best.floor)

    return queries.mapInArrow(run, "d int, v binary, q_ids binary, q_keys binary, q_floor binary").withColumnRenamed("v", "q")


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda x: np.frombuffer(x.as_buffer(), np.int64)
        held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, _Best]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(c)[i] for c in batch.schema.names}
                key, dims = cell["q_block"].as_py(), cell["d"].as_py()
                if key not in held:
                    q = _unpacked(cell["q"], dims)
                    held[key] = q, rests(q), longs(cell["q_keys"]), _Best(longs(cell["q_ids"]), longs(cell["q_floor"]), k)
                q, q_rest, _, best = held[key]
                c, rows = _unpacked(cell["v"], dims), longs(cell["ids"])
                a, b, score = survivors(q, c, q_rest, rests(c), best.floor) if dims else _all_pairs_of_empty(len(best.ids), len(rows))
                best.add(a, rows[b], score)
        for _, _, keys, best in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.ids[best.query], keys[best.query], best.found, best.score)], names=["query_id", "query_key", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of highest inner product, ties to the smaller id; all, if fewer.

    Components become floor(scale * x).  Every row is a candidate but those of the
    query's own id.  Rows without an id, and vectors that are null or hold null or
    non-finite components, take no part; whole components beyond 2**22 are cut to
    it; vectors of another length than a query's are none of its candidates.
    Repeated rows are candidates each; a query that is repeated as it is is asked
    once, and one id with several vectors is asked, and ranked, for each.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    small_batches(spark)
    vectors = whole_vectors(rows, id_col, vector_col, scale)
    seeds, orders = _seeds(vectors.limit(SEEDS).toArrow())
    queries = whole_vectors(rows.where(is_query), id_col, vector_col, scale).distinct().withColumn("key", F.xxhash64("v"))
    blocks = shared(row_blocks(vectors, orders))
    asked = shared(query_blocks(queries, seeds, orders, k).withColumn("q_block", F.sha2(F.concat("q_ids", "q"), 256)))
    n, m = max(1, blocks.count()), max(1, asked.count())
    c = min(m, max(math.ceil(m / CELL_BLOCKS), round(math.sqrt(2 * partitions(spark) * m / n))))
    r = min(n, max(1, math.ceil(2 * partitions(spark) / c)))
    dealt = lambda df, by, count, own, other: df.withColumn(own, F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit((r if count == c else c) - 1))))
    grid = dealt(blocks, ("ids", "v"), r, "row_group", "query_group").join(dealt(asked, ("q_block",), c, "query_group", "row_group").hint("shuffle_hash"), ["row_group", "query_group", "d"])
    found = grid.drop("row_group", "query_group").mapInArrow(_search(k), "query_id long, query_key long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _seeds(some: pa.Table) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[int, np.ndarray]]:
    """Seeds of each length, and the order of its dimensions by their mass among them."""
    seeds, orders = {}, {}
    for batch in some.combine_chunks().to_batches():
        for at, m in matrices(batch):
            d = m.shape[1]
            if d:
                orders[d] = np.argsort(-(m.astype(np.float64) ** 2).sum(axis=0), kind="stable")
                seeds[d] = batch.column("id").to_numpy()[at], m[:, orders[d]]
    return seeds, orders


def _all_pairs_of_empty(queries: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors without components score 0 with one another."""
    a, b = np.nonzero(np.ones((queries, rows), bool))
    return a, b, np.zeros(len(a), np.int64)
