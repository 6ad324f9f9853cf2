"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are boosted on a bounded sample of labelled rows; every path from
a root becomes a conjunctive rule.  A lasso-penalised logistic regression gives
most rules no weight; those that are left are compiled into one Spark column
expression, so that scoring is plain column arithmetic on the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import semi_by_id, shared
from .textstats import with_statistics

#: Features as SQL over the statistics; null (no words) becomes -1.
FEATURES: dict[str, str] = {
    "words": "cast(n_words as double)",
    "word_length": "try_divide(word_chars, n_words)",
    "symbols": "try_divide(n_symbols, n_words)",
    "stops": "try_divide(n_stops, n_words)",
    "upper": "try_divide(n_upper, n_chars)",
    "digits": "try_divide(n_digits, n_chars)",
    "dup_lines": "try_divide(n_dup_lines, n_lines)",
    "repeats": "try_divide(n_repeat_words, n_words)",
    "distinct": "try_divide(n_distinct_words, n_words)",
    "line_ends": "try_divide(n_line_ends, n_lines)",
    "line_words": "try_divide(n_words, n_lines)",
    "longest": "cast(longest_word as double)",
    "wide_chars": "try_divide(n_bytes, n_chars)",
}

Condition = tuple[int, bool, float]  # feature, above, threshold


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]


def _satisfied(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def _grow(bins: np.ndarray, edges: list[np.ndarray], r: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple[Condition, ...], found: dict, step: np.ndarray) -> None:
    """Split on the largest drop in squared error; paths go to found, leaf means to step."""
    best = (1e-9, None)
    if depth and len(rows) >= 2 * least:
        for f, e in enumerate(edges):
            n = np.bincount(bins[rows, f], minlength=len(e) + 1).cumsum()[:-1]
            s = np.bincount(bins[rows, f], weights=r[rows], minlength=len(e) + 1).cumsum()[:-1]
            total, m = r[rows].sum(), len(rows)
            ok = (n >= least) & (m - n >= least)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m - n, 1) - total**2 / m, -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k))
    if path:
        found.setdefault(path)
    if best[1] is None:
        step[rows] = r[rows].mean() if len(rows) else 0.0
        return
    f, k = best[1]
    high = bins[rows, f] > k
    for above in (False, True):
        _grow(bins, edges, r, rows[high == above], depth - 1, least, (*path, (f, above, float(edges[f][k]))), found, step)


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 7) -> list[tuple[Condition, ...]]:
    """Paths of boosted regression trees on half-samples."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 48))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z, found = np.zeros(len(y)), {}
    for _ in range(trees):
        r = y - 1 / (1 + np.exp(-z))
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        before = dict(found)
        _grow(bins, edges, r, rows, depth, max(5, len(y) // 200), (), found, step := np.zeros(len(y)))
        for path in [p for p in found if p not in before]:
            inside = _satisfied(x, path)
            if len(path) == depth and inside.any():
                step[inside] = r[inside].mean()
        z += 4 * rate * step
    return list(found)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the bias is not penalised."""
    n, k = a.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rate = 4.0 / max(1e-9, np.linalg.eigvalsh(a.T @ a)[-1] / n + 1)  # the largest singular value, squared
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(a @ v + c))) - y
        new = v - rate * (a.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = c - rate * g.mean()
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / u * (new - w), nb + (t - 1) / u * (nb - b)
        w, b, t = new, nb, u
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> RuleModel:
    """With no rows, or rows of one class only, the score is that share (0.5 for none)."""
    if len(y) == 0 or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return RuleModel(float(np.log((p + 1e-3) / (1 - p + 1e-3))), [])
    rules = extract_rules(x, y)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), [])
    a = np.stack([_satisfied(x, r) for r in rules], axis=1).astype(float)
    b, w = lasso_logistic(a, y, penalty)
    return RuleModel(b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if v])


def compile_rules(model: RuleModel, names: list[str]) -> Column:
    """The probability as one column expression over the features."""
    z = F.lit(model.bias)
    for rule, w in model.rules:
        hold = F.lit(True)
        for f, above, t in rule:
            hold = hold & ((F.col(names[f]) > t) if above else (F.col(names[f]) <= t))
        z = z + F.when(hold, F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    stats = with_statistics(docs, id_col, text_col, keep)
    return stats.select("doc_id", *keep, *[F.coalesce(F.expr(e), F.lit(-1.0)).cast("double").alias(n) for n, e in FEATURES.items()])


def _labelled(labels: DataFrame, label: str, sample: int) -> DataFrame:
    chosen = labels.select(F.col("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    return chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def _features_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, features) of the chosen ids, at most `sample`; of several rows of an id, the smallest features.

    Texts are measured where they are read; only numbers are shuffled.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    return features(slim).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "x.*")


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fit on at most `sample` labelled rows, the first by hash of the id; null labels and ids are left out.

    `labels` holds (doc_id, label); what it holds out must have been filtered
    before.  An id of several rows is learned from its smallest features and
    its smallest label; very long texts count whole; other columns are ignored.
    """
    chosen = _labelled(labels, label, sample)
    rows = _features_of(docs, chosen, id_col, text_col).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas()
    return fit_rules(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float))


def highest_cutoff(docs: DataFrame, labels: DataFrame, model: RuleModel, loss: float = 0.005, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> float:
    """The highest score below which at most a share `loss` of labelled good texts lies, those that the model did not learn.

    All labelled good rows count, of whatever number; 0, which rejects nothing,
    without one.  An id of several rows counts by its smallest features and label.
    """
    good = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y")).where("y = 1").select("doc_id")
    slim = semi_by_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shared(good))
    own = features(slim).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x")).select("x.*")
    scored = shared(own.select(compile_rules(model, list(FEATURES)).alias("score")))
    # The order statistic by counts of distinct scores; no more than one row reaches the driver.
    counts = scored.groupBy("score").agg(F.count("*").alias("n"))
    lost = int(loss * scored.count())
    return _at_rank(counts, lost)


def _at_rank(counts: DataFrame, rank: int) -> float:
    """The score at a rank, from 0, of (score, n); by halving the range of scores, one aggregate a round."""
    lo, hi, total = counts.agg(F.min("score"), F.max("score"), F.sum("n")).first()
    if not total:
        return 0.0
    # The smallest score with more than `rank` rows at or below it lies in [lo, hi] throughout.
    while lo < hi:
        middle = lo + (hi - lo) / 2
        below, n, above = counts.agg(F.max(F.when(F.col("score") <= middle, F.col("score"))), F.sum(F.when(F.col("score") <= middle, F.col("n"))), F.min(F.when(F.col("score") > middle, F.col("score")))).first()
        lo, hi = (lo, below) if n > rank else (above, hi)
    return lo


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, score) of every row, between 0 and 1; null and empty texts have the features of no words.

    Repeated rows and null ids are scored each; very long texts whole; columns
    outside `keep` are ignored; an empty table gives an empty result.
    """
    return features(docs, id_col, text_col, keep).select("doc_id", *keep, compile_rules(model, list(FEATURES)).alias("score"))
