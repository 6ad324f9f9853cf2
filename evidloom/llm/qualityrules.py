"""Quality rules whose cutoffs are chosen on labelled holdouts with exact binomial bounds.

Base rules drop texts outright.  Each further rule drops a text whose statistic
exceeds a cutoff; the cutoff is the lowest of a grid at which the share of good
texts that it drops is shown to be below `risk`, in each stratum on its own.
Evidence is the exact (Clopper-Pearson) upper bound of the good texts' rejection
rate among labelled ones; the error probability is divided over all rules,
strata and cutoffs (Bonferroni), and `risk` over the rules, so that all
guarantees hold at once with probability 1 - delta.  Where the labels are too few to
show it, the rule is off in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fits
from .textstats import with_statistics

#: Statistic of each rule, as a ratio; higher is worse.
RATIOS: dict[str, str] = {
    "symbols": "try_divide(n_symbols, n_words)",
    "dup_lines": "try_divide(n_dup_lines, n_lines)",
    "repeats": "try_divide(n_repeat_words, n_words)",
    "long_words": "try_divide(word_chars, n_words)",
    "bare_lines": "1 - try_divide(n_line_ends, n_lines)",
}
GRIDS: dict[str, list[float]] = {
    "symbols": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0],
    "dup_lines": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeats": [0.05, 0.1, 0.15, 0.2, 0.25],
    "long_words": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
    "bare_lines": [0.2, 0.4, 0.6, 0.8, 0.95],
}
#: Strata by length, in words.
STRATA = [100, 300, 1000]


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 0
    while m < 100_000:
        m += 1
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + part * d or tiny)
            c = 1 + part / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def at_most(k: int, n: int, p: float) -> float:
    """Probability of at most k of n at rate p."""
    return 1.0 if k >= n else _beta_share(n - k, k + 1, 1 - p)


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Clopper-Pearson upper bound at 1 - alpha: the p at which at most k of n has probability alpha."""
    if k >= n:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if at_most(k, n, p) > alpha else (lo, p)
    return hi


def stratum() -> Column:
    out = F.lit(0)
    for s in STRATA:
        out = out + F.when(F.col("n_words") >= s, 1).otherwise(0)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def choose_cutoffs(good: DataFrame, risk: float, delta: float) -> dict[tuple[str, int], float]:
    """(rule, stratum) -> cutoff, from the statistics of labelled good texts that pass the base rules.

    Counts of the whole holdout are taken by one aggregate; only these pass through the driver.
    """
    tests = sum(map(len, GRIDS.values())) * (len(STRATA) + 1)
    counts = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, g in GRIDS.items() for i, c in enumerate(g)]
    out = {}
    for row in good.groupBy("stratum").agg(F.count("*").alias("n"), *counts).collect():
        for r, g in GRIDS.items():
            # The bound is at most the risk just where so few rejections are that unlikely at the risk itself.
            ok = [c for i, c in enumerate(g) if at_most(row[f"{r}_{i}"], row["n"], risk / len(GRIDS)) <= delta / tests]
            if ok:
                out[r, row["stratum"]] = min(ok)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the statistics, base_failed, stratum, failed_rules, kept) of every row.

    `labels` has doc_id and quality (1: good); all its rows are the holdout, as
    nothing else is learned from them.  At most a share `risk` of the good texts
    of a stratum is dropped by the learned rules.  Null and empty texts have no
    words, fail the base rules and are not kept.  Repeated rows are judged each,
    and count each in the holdout; a doc_id with several labels counts as good
    only if none is 0.  Very long texts are judged whole; other columns are
    ignored; without labels no learned rule is on; an empty table gives an empty result.
    """
    ratio = {r: F.coalesce(F.expr(e), F.lit(0.0)) for r, e in RATIOS.items()}

    def judged(rows: DataFrame) -> DataFrame:
        stats = with_statistics(rows, id_col, text_col)
        return stats.select("*", stratum().alias("stratum"), base_failed().alias("base_failed"), *[c.alias(r) for r, c in ratio.items()])

    good = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    if fits(good):  # only labelled texts need their statistics now; more labels than fit are met by the statistics, which are narrower than texts
        some = docs.join(F.broadcast(good.select(F.col("doc_id").alias("_good"))), F.col(id_col) == F.col("_good"), "left_semi")
        holdout = judged(some)
    else:
        holdout = judged(docs).join(good, "doc_id", "left_semi")
    cutoffs = choose_cutoffs(holdout.where("not base_failed"), risk, delta)
    failed = [F.when((F.col("stratum") == s) & (F.col(r) > c), F.lit(r)) for (r, s), c in sorted(cutoffs.items())]
    rules = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    out = judged(docs).withColumn("failed_rules", rules)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
