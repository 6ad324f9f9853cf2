"""Whitening of embeddings: principal components by a randomised range finder and Rayleigh-Ritz.

The fit list holds each distinct whole-number vector once.  Every pass multiplies
the covariance by a narrow basis, from all centred rows of the list: a task sums
c (c'Q) over its rows, and tasks' sums, of dimensions x width numbers, are added
up by Spark.  A range of width `components` + `oversample` is drawn at random and
sharpened by power passes; Rayleigh-Ritz in that range gives eigenpairs and their
residuals.  Where a residual is too large, as where the spectrum is flat, the
basis grows to all dimensions, in which Rayleigh-Ritz is the whole
decomposition.  What the driver holds doesn't grow with the rows: at most
dimensions x dimensions numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import shared, small_batches

#: Whole components stay within this, so that n * x fits a long for billions of rows.
LARGEST = 1 << 30
#: A residual may be so large a part of the largest eigenvalue; smaller eigenvalues than LEAST of it span nothing.
RESIDUAL, LEAST = 1e-13, 1e-12
#: Rows of a matrix product; bytes of vectors that a task of a pass takes.
_ROWS, _TASK_BYTES = 4096, 16 << 20


def whole_rows(rows: DataFrame, vector_col: str, scale: int, shift: int, *keep: str) -> DataFrame:
    """(*keep, x) with x = floor(scale * component) + shift, of rows whose vector holds finite components only."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + shift)
    return rows.where(v.isNotNull() & ~bad).select(*keep, whole.alias("x"))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].reshape(len(column), d)


def _centred(column: pa.ListArray, n: int, sums: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n*x - S, exact; x - S/n) by blocks of rows."""
    x = _matrix(column, len(sums))
    for lo in range(0, len(x), _ROWS):
        whole = n * x[lo : lo + _ROWS] - sums
        yield whole, whole / n


def _summed(partials: DataFrame, d: int, width: int) -> np.ndarray:
    """The sum of the tasks' (d x width) matrices, added up on the executors."""
    out = np.zeros((d, width))
    cells = partials.select("row", F.posexplode("cells").alias("pos", "c")).groupBy("row", "pos").agg(F.sum("c").alias("c")).toArrow()
    out[cells["row"].to_numpy(), cells["pos"].to_numpy()] = cells["c"].to_numpy()
    return out


def _rows_of(m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))], names=["row", "cells"])


@dataclass(frozen=True)
class Whitener:
    """What turns a whole-number vector into its whitened components."""

    n: int
    sums: np.ndarray
    directions: np.ndarray  # dimensions x components
    values: np.ndarray
    trace: float
    full: bool  # whether the basis had to grow to all dimensions
    identity_error: float = 0.0

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.directions / np.sqrt(self.values)


def _times_covariance(fit: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """V @ basis, by one pass over all centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for _, c in _centred(batch.column("x"), n, sums):
                total += c.T @ (c @ basis)
        yield _rows_of(total / n)

    return _summed(fit.mapInArrow(run, "row int, cells array<double>"), *basis.shape)


def _trace(fit: DataFrame, n: int, sums: np.ndarray) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(float((c**2).sum()) for b in batches for _, c in _centred(b.column("x"), n, sums)) / n])], names=["t"])

    return fit.mapInArrow(run, "t double").agg(F.sum("t")).first()[0] or 0.0


def _ritz(basis: np.ndarray, image: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, directions and the largest residual, as a part of the largest eigenvalue, in the range of a basis."""
    small = basis.T @ image
    values, turns = np.linalg.eigh((small + small.T) / 2)
    values, turns = values[::-1][:components], turns[:, ::-1][:, :components]
    directions = basis @ turns
    residual = np.abs(image @ turns - directions * values).max(initial=0.0)
    return values, directions, residual / max(values[0], 1e-300)


def fit_whitener(fit: DataFrame, components: int = 16, oversample: int = 10, power_passes: int = 3, seed: int = 20240607) -> Whitener | None:
    """The whitener of a list of distinct vectors x of one length; None of an empty list, or of vectors without components."""
    n = fit.count()
    places = fit.select(F.posexplode("x").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("s"), F.max("x").alias("high"), F.min("x").alias("low")).collect()  # a row for each dimension
    if not places:
        return None
    sums = np.array([r["s"] for r in sorted(places, key=lambda r: r["place"])], np.int64)
    d = len(sums)
    width = min(d, components + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for left in range(power_passes, -1, -1):
        image = _times_covariance(fit, n, sums, basis)
        values, directions, residual = _ritz(basis, image, components)
        if residual <= RESIDUAL or width == d:
            break
        if left:
            basis = np.linalg.qr(image)[0]
    grown = residual > RESIDUAL and width < d
    if grown:
        rest = np.random.default_rng(seed + 1).standard_normal((d, d - width))
        basis = np.linalg.qr(np.hstack([basis, rest]))[0]
        values, directions, _ = _ritz(basis, _times_covariance(fit, n, sums, basis), components)
    spans = values > max(values[0], 0.0) * LEAST
    out = Whitener(n, sums, directions[:, spans], values[spans], _trace(fit, n, sums), grown)
    return Whitener(n, sums, out.directions, out.values, out.trace, grown, _identity_error(fit, out))


def _identity_error(fit: DataFrame, w: Whitener) -> float:
    """Largest entry, without its sign, of the whitened rows' covariance minus the identity, by one more pass."""
    k = len(w.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for _, c in _centred(batch.column("x"), w.n, w.sums):
                y = w.whitened(c)
                total += y.T @ y
        yield _rows_of(total / w.n)

    return float(np.abs(_summed(fit.mapInArrow(run, "row int, cells array<double>"), k, k) - np.eye(k)).max())


def deviations(whole: np.ndarray) -> list[int | None]:
    """Sum of squares of each row of exact longs; null where it does not fit a long."""
    if float(np.abs(whole).max(initial=0)) ** 2 * whole.shape[1] < 2.0**62:
        return (whole * whole).sum(axis=1).tolist()
    each = [sum(int(x) ** 2 for x in row) for row in whole]
    return [x if x < 1 << 63 else None for x in each]


def whiten(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, full_basis) of each row and component.

    Components are numbered from 1 by falling eigenvalue; those of eigenvalue 0
    (or below 1e-12 of the largest) can't be scaled and are left out.  Vectors that
    are null or hold null or non-finite components are dropped, and so are those of
    another length than most distinct ones have (ties: the longer).  Repeated rows
    are returned each and fitted once; null ids are kept; whole components beyond
    2**30 are cut to it before the shift; a deviation that does not fit a long is
    null.  Other columns are ignored.  An empty table, vectors without components
    and vectors that are all equal give an empty result.
    """
    spark = rows.sparkSession
    small_batches(spark)
    distinct = shared(whole_rows(rows, vector_col, scale, shift).distinct())
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d"))["d"]).first()[0] or 0
    fit = distinct.where(F.size("x") == lengths)
    tasks = math.ceil(distinct.count() * 8 * lengths / _TASK_BYTES)
    model = fit_whitener(fit.coalesce(max(1, tasks)), components) if lengths else None
    schema = f"vec_id {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, full_basis boolean"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    k, share = len(model.values), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for whole, c in _centred(batch.column("x"), model.n, model.sums):
                m = len(c)
                ids = batch.column("vec_id").slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array(deviations(whole), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                tiled = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), model.whitened(c).ravel(), np.tile(share, m)]
                cells = [ids, pa.array(tiled[0]), pa.array(np.full(m * k, model.n)), deviation, pa.array(tiled[1]), pa.array(tiled[2]), pa.array(np.full(m * k, model.identity_error)), pa.array(np.full(m * k, model.full))]
                yield pa.RecordBatch.from_arrays(cells, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "full_basis"])
                at += m

    return whole_rows(rows, vector_col, scale, shift, F.col(id_col).alias("vec_id")).where(F.size("x") == lengths).mapInArrow(run, schema)
