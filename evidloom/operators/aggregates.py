"""Grouped statistics: likelihoods, calibration, ranking quality, intervals, multiple testing, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cut

#: Answers up to which one number holds those of a case, a bit for each.
ANSWERS = 63


def answer_bits(answers: DataFrame, known: list[tuple], case: str, answer: list[str]) -> DataFrame:
    """(case, bits): which of at most ANSWERS known answers a case gives; cases that give none are left out.

    Every task ors its rows of a case before the shuffle, so a case moves as two numbers.
    """
    kinds = ", ".join(f"`{c}` {answers.schema[c].dataType.simpleString()}" for c in answer)
    bits = answers.sparkSession.createDataFrame([(*k, 1 << n) for n, k in enumerate(known)], f"{kinds}, bits long")
    return answers.join(F.broadcast(bits), answer).groupBy(case).agg(F.bit_or("bits").alias("bits"))  # ANSWERS rows at most


def smoothed_likelihood(tokens: DataFrame, labels: DataFrame, case: str, label: str, code: str, value: str, alpha: float = 1.0, once: bool = False) -> DataFrame:
    """(code, value, label, p): (n + alpha) / (total + alpha * k) over the k values that a code has anywhere.

    Counting is one partial aggregate; only the small table of counts is made dense.
    With `once`, a token that a case has several times counts once.
    """
    known = tokens.select(code, value).distinct().limit(ANSWERS + 1).collect() if once else []
    if 0 < len(known) <= ANSWERS and not any(x is None for k in known for x in k):
        has = answer_bits(tokens, known, case, [code, value]).join(labels, case)
        sums = has.groupBy(label).agg(*[F.sum(F.getbit("bits", F.lit(k)).cast("long")).alias(f"_n{k}") for k in range(len(known))])
        each = F.array(*[F.struct(F.lit(k[code]).alias(code), F.lit(k[value]).alias(value), F.col(f"_n{n}").alias("n")) for n, k in enumerate(known)])
        counts = sums.select(label, F.inline(each)).where("n > 0")
    else:
        tokens = tokens.select(case, code, value).distinct() if once else tokens
        counts = tokens.join(labels, case).groupBy(code, value, label).agg(F.count("*").alias("n"))
    space = counts.select(code, value).distinct().crossJoin(F.broadcast(labels.select(label).distinct()))  # answers x labels: dimensions
    dense = space.join(counts, [code, value, label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(code, label)
    return dense.select(code, value, label, ((F.col("n") + alpha) / (F.sum("n").over(w) + alpha * F.count("*").over(w))).alias("p"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % score interval of a share; null without trials."""
    p, zz = k / n, F.lit(z * z)
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    some = n > 0
    return F.when(some, mid - half), F.when(some, mid + half)


def binned_calibration_error(df: DataFrame, confidence: str, correct: str, keys: list[str], bins: int = 15) -> DataFrame:
    """Weighted gap between confidence and accuracy over equal right-closed bins (the first closed on both sides)."""
    b = F.greatest(F.ceil(F.col(confidence) * bins), F.lit(1))
    each = df.groupBy(*keys, b.alias("_bin")).agg(F.count("*").alias("_n"), F.sum(confidence).alias("_c"), F.sum(F.col(correct).cast("int")).alias("_k"))
    return each.groupBy(*keys).agg((F.sum(F.abs(F.col("_c") - F.col("_k"))) / F.sum("_n")).alias("ece"))


def auroc(df: DataFrame, score: str, positive: str, keys: list[str]) -> DataFrame:
    """Mann-Whitney area over average tied ranks for each group; null when a class is missing.

    Equal scores are aggregated first, so the running sums go over distinct scores only.
    """
    each = df.groupBy(*keys, score).agg(F.count_if(positive).alias("_p"), F.count_if(~F.col(positive)).alias("_q"))
    before = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_q").over(before), F.lit(0))
    won = each.select(*keys, "_p", "_q", (F.col("_p") * (below + F.col("_q") / 2)).alias("_won"))
    p, q = F.sum("_p"), F.sum("_q")
    return won.groupBy(*keys).agg(F.when((p > 0) & (q > 0), F.sum("_won") / (p * q)).alias("auroc"), p.alias("n_pos"), q.alias("n_neg"))


def average_precision(df: DataFrame, score: str, positive: str, keys: list[str]) -> DataFrame:
    """Sum of precision times recall gain over distinct scores from the top; null without positives."""
    each = df.groupBy(*keys, score).agg(F.count_if(positive).alias("_p"), F.count("*").alias("_n"))
    top = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    cum = each.select(*keys, "_p", (F.sum("_p").over(top) / F.sum("_n").over(top)).alias("_precision"))
    return cum.groupBy(*keys).agg(F.when(F.sum("_p") > 0, F.sum(F.col("_p") * F.col("_precision")) / F.sum("_p")).alias("ap"))


def holm(df: DataFrame, p: str, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """df with Holm's adjusted p (running maximum, at most 1) and the step-down decision; equal p share a fate."""
    group = Window.partitionBy(*keys)
    order = group.orderBy(p)
    raw = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(group) - F.rank().over(order) + 1))
    out = df.withColumn("_raw", raw).withColumn("p_adjusted", F.max("_raw").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return out.drop("_raw").withColumn("rejected", F.col("p_adjusted") <= alpha)


def poisson_weight(seed: int, *keys: str) -> Column:
    """How often a row is drawn: a Poisson(1) quantile, at most 7, of a hash of its keys."""
    u = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 8):
        total += term
        weight = weight + (u >= total).cast("int")
        term /= k
    return weight


def stratified_bootstrap(df: DataFrame, stratum: str, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, estimate): rows are drawn within each stratum, whose means are pooled by the strata's true sizes.

    Sums are combined in each task, so (replicate, stratum) rows are all that is shuffled;
    a replicate that draws nothing of a stratum leaves it out.
    """
    many = df.where(F.col(value).isNotNull()).select(F.col(stratum).alias("_s"), key, F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    w = many.withColumn("_w", poisson_weight(seed, "replicate", key))
    each = w.groupBy("replicate", "_s").agg((F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum("_w"))).alias("_m"), F.count("*").alias("_n")).where("_m is not null")
    return each.groupBy("replicate").agg((F.sum(F.col("_m") * F.col("_n")) / F.sum("_n")).alias("estimate"))


def hash_bootstrap(df: DataFrame, cluster: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, estimate): means over clusters drawn with Poisson(1) weights from a hash, without a driver loop.

    A cluster is reduced to (sum, n) first; only those small rows meet the replicates.
    """
    per = df.groupBy(cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    many = per.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return many.withColumn("_w", poisson_weight(seed, "replicate", cluster)).groupBy("replicate").agg((F.sum(F.col("_s") * F.col("_w")) / F.sum(F.col("_n") * F.col("_w"))).alias("estimate"))


def suppressed(n: Column, least: int = 10) -> Column:
    """A count as a coarse bucket, so that small cells are not told."""
    return F.when(n < least, F.lit(f"<{least}")).when(n < 10 * least, F.lit(f"{least}-{10 * least - 1}")).when(n < 100 * least, F.lit(f"{10 * least}-{100 * least - 1}")).otherwise(F.lit(f">={100 * least}"))


def share_bin(n: Column, total: Column) -> Column:
    """Tenth of a share, 0 to 9."""
    return F.least(F.floor(10 * n / total), F.lit(9))


def quartiles(df: DataFrame, value: str, keys: list[str], least: int = 30) -> DataFrame:
    """Inclusive quartiles of groups with at least so many values; null below."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("_q"))
    return out.select(*keys, "n", *[F.when(F.col("n") >= least, F.col("_q")[k]).alias(f"q{k + 1}") for k in range(3)])


def cuts_at_or_below(x: Column, cuts: Column) -> Column:
    """1 + how many of the array's cut points are <= x."""
    return F.size(F.filter(cuts, lambda c: c <= x)) + 1


def mean_at_least(df: DataFrame, keys: list[str], value: str, bound: float, at: str, name: str) -> DataFrame:
    """(keys, name): whether the mean of a group's doubles, added up in the order of `at`, is `bound` or more; false without values.

    Sums in another order differ by rounding only, so they settle every group whose
    mean is further from the bound than rounding reaches.  Only the rows of the
    others are put in order, and added up by a window, which holds no whole group.
    """
    g = cut(df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"), F.avg(F.abs(value)).alias("_a")))
    close = F.coalesce(F.abs(F.col("_m") - bound) <= F.col("_a") * (1e-12 + F.col("_n") * 5e-16), F.lit(False))
    edge = g.where(close).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col(value).isNotNull()).join(edge, same, "left_semi").withColumn("_sum", F.sum(value).over(w))
    exact = rows.groupBy(*keys).agg((F.max_by("_sum", at) / F.count("*")).alias("_m"))
    return g.where(~close).select(*keys, "_m").unionByName(exact).select(*keys, F.coalesce(F.col("_m") >= bound, F.lit(False)).alias(name))
