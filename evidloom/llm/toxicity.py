"""Toxicity by non-negative positive-unlabelled learning on hashed words and word beginnings.

Only confirmed toxic texts carry a label; all other texts are unlabelled and
hold toxic ones at the class prior.  The risk of a linear classifier on word
presence is estimated from both, corrected for the prior, and its negative part
is kept from falling below zero, which would be overfitting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as bo
from .runtime import shared

SPACE = 20  # bits of the hashed word space
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes of a word's beginnings, features beside the word
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass(frozen=True)
class PuModel:
    bias: float
    weight: np.ndarray  # one for each hashed word


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (runs of letters, A-Z lower-cased) and their beginnings, with the text of each; may repeat."""
    data = bo.LOWER[data]
    starts, ends, doc = bo.spans_where(_LETTER[data], offsets)
    h, who = [bo.span_hashes(data, starts, ends)], [doc]
    for n in BEGINNINGS:
        longer = ends - starts > n
        h.append(bo.span_hashes(data, starts[longer], starts[longer] + n, salt=n))
        who.append(doc[longer])
    return (np.concatenate(h) >> np.uint64(64 - SPACE)).astype(np.int64), np.concatenate(who)


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, sorted by text."""
    h, doc = features_of(data, offsets)
    key = np.unique(doc << SPACE | h)
    return key & ((1 << SPACE) - 1), key >> SPACE


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in bo.chunked(batch.column(1)):
            ids, doc = word_ids(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), bo.list_array(ids, bo.offsets_of(doc, hi - lo), pa.int32())], names=["doc_id", "words"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, u): in how many of a task's texts each hashed feature is."""
    total = np.zeros(1 << SPACE, np.int64)
    for batch in batches:
        for _, _, data, offsets in bo.chunked(batch.column(0)):
            ids, _ = word_ids(data, offsets)
            total += np.bincount(ids, minlength=1 << SPACE)
    w = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(total[w])], names=["w", "u"])


def departing_words(pos: DataFrame, unl: DataFrame, n_pos: int, n_unl: int, vocabulary: int, least: int) -> np.ndarray:
    """The words (w) whose presence among the positives (p) departs most from the unlabelled (u), sorted."""
    both = pos.join(unl, "w", "full").na.fill(0).where(F.col("p") + F.col("u") >= least)
    rate = (F.col("u") + 1.0) / (n_unl + 2.0)
    depart = F.abs(F.col("p") / max(1, n_pos) - rate) / F.sqrt(rate * (1 - rate) / max(1, n_pos))
    return np.sort(np.array([r["w"] for r in both.orderBy(F.desc(depart), "w").limit(vocabulary).select("w").collect()], np.int64))


def nn_pu_fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, chosen: np.ndarray, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> PuModel:
    """Adam on the non-negative risk prior * R+(pos) + max(0, R-(unl) - prior * R-(pos)), logistic loss.

    Texts are given as the places of their words in `chosen`.  Without positives
    or unlabelled texts the score is the prior.
    """
    weight = np.zeros(1 << SPACE, np.float32)
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not pos or not unl:
        return PuModel(base, weight)
    np_, nu = len(pos), len(unl)
    (rp, kp), (ru, ku) = ((np.repeat(np.arange(len(x)), [len(t) for t in x]), np.concatenate(x)) for x in (pos, unl))
    w, b, m, v = np.zeros(len(chosen) + 1), base, 0.0, 0.0
    for t in range(1, rounds + 1):
        sp = 1 / (1 + np.exp(-(np.bincount(rp, weights=w[kp], minlength=np_) + b)))
        su = 1 / (1 + np.exp(-(np.bincount(ru, weights=w[ku], minlength=nu) + b)))
        negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
        gp_plus, gp_minus, gu = prior * (sp - 1) / np_, -prior * sp / np_, su / nu
        if negative >= 0:
            gp = gp_plus + gp_minus
        else:  # step back from the part that went below zero
            gp, gu = -gp_minus, -gu
        g = np.bincount(kp, weights=gp[rp], minlength=len(w)) + np.bincount(ku, weights=gu[ru], minlength=len(w))
        g[-1] = gp.sum() + gu.sum()
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-1] -= move[:-1]
        b -= move[-1]
    weight[chosen] = w[:-1]
    return PuModel(float(b), weight)


def _places(chosen: np.ndarray):
    """Word lists -> places of the chosen words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets, np.int64)
            w = np.asarray(lists.values, np.int64)[offsets[0] : offsets[-1]]
            at = np.minimum(np.searchsorted(chosen, w), max(0, len(chosen) - 1))
            hit = chosen[at] == w if len(chosen) else np.zeros(len(w), bool)
            before = np.concatenate([[0], np.cumsum(hit)])[offsets - offsets[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bo.list_array(at[hit], before, pa.int32())], names=["p", "u", "words"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, vocabulary: int = 2048, least: int = 10, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> PuModel:
    """Fit on at most `sample` confirmed toxic and `sample` unlabelled texts, the first by hash of the id.

    `docs` and `labels` hold what may be learned from; the class prior is the
    share of toxic among all labelled rows, and the rates of words are counted
    over all texts of `docs`.  Only the risk itself is a mean over the bounded
    sample: of 10,000 texts, its standard error is a hundredth of the loss's
    spread at most, at any size of the corpus.  Null ids and labels are left out;
    an id of several rows is learned from its smallest text, one of several
    labels is toxic if any says so; other columns are ignored; very long texts
    count whole; without labels or texts the score is the prior.  The driver
    takes `vocabulary` words, and of each text of the sample these at most.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    prior = known.agg(F.avg("y")).first()[0]
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pos = known.where("y = 1").orderBy(*order).limit(sample).select("doc_id", F.lit(1).alias("p"))
    unl = slim.select("doc_id").distinct().orderBy(*order).limit(sample).select("doc_id", F.lit(1).alias("u"))
    chosen = shared(pos.join(unl, "doc_id", "full").na.fill(0))
    texts = slim.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))  # at most twice `sample` ids
    words = texts.mapInArrow(_words_of, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, words array<int>")
    rows = shared(words.join(F.broadcast(chosen), "doc_id").select("doc_id", "p", "u", "words"))
    n_pos = rows.agg(F.coalesce(F.sum("p"), F.lit(0))).first()[0]
    every = slim.select("text").mapInArrow(_document_counts, "w int, u long").groupBy("w").agg(F.sum("u").alias("u"))
    found = rows.where("p = 1").select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("p"))
    vocab = departing_words(found, every, n_pos, slim.count(), vocabulary, least)
    kept = rows.orderBy("doc_id").select("p", "u", "words").mapInArrow(_places(vocab), "p int, u int, words array<int>").toPandas()
    take = lambda who: [np.asarray(w, np.int64) for w in kept.loc[kept[who] == 1, "words"]]
    return nn_pu_fit(take("p"), take("u"), float(prior if prior is not None else 0.0), vocab)


def score(docs: DataFrame, model: PuModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts have no words and the score of the bias.

    Repeated rows and null ids are scored each; very long texts whole; other
    columns are ignored; an empty table gives an empty result.
    """
    bias, weight = model.bias, model.weight
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bo.chunked(batch.column(1)):
                h, doc = features_of(data, offsets)
                hit = weight[h] != 0
                key = np.unique(doc[hit] << SPACE | h[hit])
                z = np.bincount(key >> SPACE, weights=weight[key & ((1 << SPACE) - 1)], minlength=hi - lo) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
