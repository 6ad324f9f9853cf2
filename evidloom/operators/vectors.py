"""Nearest vectors by cosine: inverted lists around centres, and an exact ranking of the rows that the lists hold.

Centres are fitted on a bounded sample; every row is indexed.  Rows of a list meet
the queries that probe it in a grid of cells, each of a bounded number of rows and
queries, so a list that holds a third of all rows is spread over many tasks.
Without centres all rows are one list, and the answer is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import top_k

#: Rows and queries that a cell holds on average.
ROWS, QUERIES = 2048, 512


def unit_vectors(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, u): vectors of length one, as doubles.

    Null ids, null and empty vectors, those with null or non-finite components, of
    length zero, or of another number of components than most rows take no part.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("u"))
    v = v.where(F.col("id").isNotNull() & F.forall("u", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = v.groupBy(F.size("u").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    v = v.where(F.size("u") == (most["d"] if most else 0)).withColumn("norm", F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)))
    return v.where("norm > 0").select("id", "label", F.transform("u", lambda x: x / F.col("norm")).alias("u"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sample_of(unit: DataFrame, rows: int) -> np.ndarray:
    """At most so many vectors, the first by hash of the id."""
    held = unit.orderBy(F.xxhash64("id"), "id").limit(rows).select("u").toArrow()["u"]
    return _matrix(held) if len(held) else np.zeros((0, 0))


def fit_centres(sample: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """k-means on the sphere, from distinct vectors of the sample; at most n centres, none from an empty sample."""
    if not len(sample):
        return sample
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(11).permutation(len(centres))[:n]]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest lists that a query must probe for this mean recall of its k nearest, measured on the sample against brute force."""
    k = min(k, len(sample) - 1)
    if k < 1:
        return max(1, len(centres))
    asked = sample[:1000]
    near = asked @ sample.T
    np.fill_diagonal(near, -np.inf)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each list in a query's order
    needed = np.take_along_axis(place, (sample @ centres.T).argmax(axis=1)[best], axis=1)
    found = np.bincount(needed.ravel(), minlength=len(centres)).cumsum() / needed.size
    return int(np.searchsorted(found, recall - 1e-12) + 1)


def into_lists(unit: DataFrame, centres: np.ndarray | None, probes: int = 1) -> DataFrame:
    """unit with `list`: one row for each of the `probes` nearest centres; list 0 for all without centres."""
    if centres is None or not len(centres):
        return unit.withColumn("list", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = np.argsort(-(_matrix(b.column("u")) @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            again = b.take(pa.array(np.repeat(np.arange(b.num_rows), near.shape[1])))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(near.ravel())], names=[*again.schema.names, "list"])

    return unit.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in unit.schema) + ", list int")


def _best_of_cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """Each query's best row of every label in a cell; ties to the smaller id."""
    names = ["query_id", "id", "label", "cosine"]
    if not rows.num_rows or not asked.num_rows:
        return pa.Table.from_arrays([pa.array([], asked.schema.field("query_id").type), pa.array([], rows.schema.field("id").type), pa.array([], rows.schema.field("label").type), pa.array([], pa.float64())], names=names)
    rows = rows.sort_by("id")
    code = rows["label"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    rows, code = rows.take(pa.array(order)), code[order]
    near = np.round(_matrix(asked["u"]) @ _matrix(rows["u"]).T, 6)
    place = {x: i for i, x in enumerate(rows["id"].to_pylist())}
    for i, q in enumerate(asked["query_id"].to_pylist()):
        if (own := place.get(q)) is not None:
            near[i, own] = -np.inf
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    at = np.stack([a + near[:, a:b].argmax(axis=1) for a, b in zip(starts, [*starts[1:], len(code)], strict=True)], axis=1)
    score = np.take_along_axis(near, at, axis=1)
    q, s = np.nonzero(np.isfinite(score))
    hit = rows.take(pa.array(at[q, s]))
    return pa.Table.from_arrays([asked["query_id"].take(pa.array(q)), hit["id"], hit["label"], pa.array(score[q, s])], names=names)


def nearest_labels(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, label, cosine): for each query the best row of every label among the lists it probes, then the k best labels.

    rows: (id, label, u, list), each row in one list; asked: (query_id, u, list).
    A query never finds its own id.  Cosines are rounded to 6 places; ties go to the
    smaller id, then the smaller label.
    """
    parts = lambda df, most, name: df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    # One row for each list, so no more than there are centres.
    grid = F.broadcast(parts(rows, ROWS, "_rows").join(parts(asked, QUERIES, "_asked"), "list"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.join(grid, "list").withColumn("row_part", F.pmod(F.xxhash64("id"), "_rows").cast("int")).withColumn("ask_part", each("_asked")).drop("_rows", "_asked")
    asked = asked.join(grid, "list").withColumn("ask_part", F.pmod(F.xxhash64("query_id"), "_asked").cast("int")).withColumn("row_part", each("_rows")).drop("_rows", "_asked")
    cell = ["list", "row_part", "ask_part"]
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    met = asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(lambda a, r: _best_of_cell(r, a), f"query_id {kind(asked, 'query_id')}, id {kind(rows, 'id')}, label {kind(rows, 'label')}, cosine double")
    best = met.groupBy("query_id", "label").agg(F.min_by(F.struct("id", "cosine"), F.struct(-F.col("cosine"), F.col("id"))).alias("b"))
    return top_k(best.select("query_id", "b.id", "label", "b.cosine"), ["query_id"], [F.desc("cosine"), F.asc("label")], k)


def nearest_by_cosine(vectors: DataFrame, id_col: str, vector: str, label: str, is_query: Column, k: int, centres: int = 0, recall: float = 0.95, sample: int = 20_000) -> DataFrame:
    """(query_id, id, label, cosine): for each query the best row of every label, then the k best labels.

    Exact without `centres`.  With them every row is put into the list of its nearest
    centre; a query probes as many lists as reach `recall` of the 10 nearest on the
    sample, at most `sample` rows, on which the centres are fitted too.
    """
    unit = unit_vectors(vectors, id_col, vector, label)
    asked = unit_vectors(vectors.where(is_query), id_col, vector, label).select(F.col("id").alias("query_id"), "u")
    middle, probes = None, 1
    if centres:
        held = sample_of(unit, sample)
        middle = fit_centres(held, centres)
        probes = probes_for(held, middle, 10, recall)
    return nearest_labels(into_lists(unit, middle), into_lists(asked, middle, probes), k)
