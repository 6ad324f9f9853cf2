"""Ordered computations over keys: first and last rows, ranks, running groups, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the smallest order values; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def pessimistic_rank(df: DataFrame, score: str, keys: list[str], name: str = "rank") -> DataFrame:
    """df with 1 + rows above + further rows of the same score, worked out on distinct scores; null scores come last."""
    each = df.groupBy(*keys, score).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0))
    rank = each.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*keys, score])], upto.alias(name))
    same = [df[c].eqNullSafe(rank[f"_{i}"]) for i, c in enumerate([*keys, score])]
    return df.join(rank, same).select(*[df[c] for c in df.columns], name)


def average_rank(df: DataFrame, score: str, keys: list[str], name: str = "rank") -> DataFrame:
    """df with the mean rank of equal scores; ranks are worked out on distinct scores and joined back."""
    each = df.groupBy(*keys, score).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2
    return df.join(each.select(*keys, score, rank.alias(name)), [*keys, score])


def empirical_cdf(train: DataFrame, test: DataFrame, value: str, keys: list[str], name: str = "percentile") -> DataFrame:
    """test with (train below + half of train equal) / train, per key; null where a key has no training rows."""
    each = train.groupBy(*keys, value).agg(F.count("*").alias("_n")).unionByName(test.select(*keys, value).distinct().withColumn("_n", F.lit(0).cast("long")))
    each = each.groupBy(*keys, value).agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(w)
    cdf = each.select(*keys, value, F.when(total > 0, (below + F.col("_n") / 2) / total).alias(name))
    return test.join(cdf, [*keys, value], "left")


def running_group(df: DataFrame, keys: list[str], order: list[str], boundary: Column, name: str = "group_no") -> DataFrame:
    """df with the number of boundaries up to and with each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(boundary.cast("long")).over(w))


def previous_known(df: DataFrame, keys: list[str], order: list[str], known: Column, value: Column, name: str = "previous") -> DataFrame:
    """df with the value of the last earlier row for which `known` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(known, value), ignorenulls=True).over(w))


def episodes(df: DataFrame, keys: list[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """(keys, episode, started, ended, n): an opening row starts one unless it is open, a closing row ends it.

    Rows that neither open nor close are left out; `ended` is null for the one still open.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, opens.alias("_open"), closes.alias("_close")).where("_open or _close")
    was = F.coalesce(F.lag("_open").over(w), F.lit(False))
    rows = rows.withColumn("_was", was).where("_open or _was")  # a close without an open one is no event
    rows = rows.withColumn("episode", F.sum((F.col("_open") & ~F.col("_was")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "episode").agg(F.min(order).alias("started"), F.max(F.when(F.col("_close"), F.col(order))).alias("ended"), F.count_if("_open").alias("n"))


def round_robin_folds(df: DataFrame, stratum: str, key: Column, folds: int) -> DataFrame:
    """df with a fold, dealt in hash order within each stratum.

    Rows are numbered inside 4,096 ranges of the hash, after the counts of the
    ranges before, so that no task orders a whole stratum.
    """
    rows = df.withColumn("_h", F.sha2(key, 256)).withColumn("_r", F.substring("_h", 1, 3))
    before = F.sum("_n").over(Window.partitionBy(stratum).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    start = rows.groupBy(stratum, "_r").agg(F.count("*").alias("_n")).select(F.col(stratum).alias("_s"), F.col("_r").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = rows.withColumn("_i", F.row_number().over(Window.partitionBy(stratum, "_r").orderBy("_h", key)))
    both = place.join(start, place[stratum].eqNullSafe(start["_s"]) & (place["_r"] == start["_q"]))
    return both.withColumn("fold", ((F.col("_before") + F.col("_i") - 1) % folds).cast("int")).select(*df.columns, "fold")


def inherited_back(labels: Column) -> Column:
    """An array of labels in which a null takes the label of the next element that has one."""
    step = lambda acc, x: F.concat(F.array(F.coalesce(x, F.get(acc, F.lit(0)))), acc)
    return F.aggregate(F.reverse(labels), F.array().cast("array<string>"), step)


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the last non-null value up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def non_overlapping(spans: Column) -> Column:
    """Greedy choice from an array of (start, end) structs: leftmost, then longest, never overlapping."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.sign(a["start"] - b["start"])).otherwise(F.sign(b["end"] - a["end"])).cast("int"))
    none = F.filter(spans, lambda x: F.lit(False))
    return F.aggregate(ordered, none, lambda acc, s: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= s["start"]), F.concat(acc, F.array(s))).otherwise(acc))


def micros(at: str) -> Column:
    """Microseconds of a time without zone since 1970, for frames that leave out rows of the same time."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(at))
