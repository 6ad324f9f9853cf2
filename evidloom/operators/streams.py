"""Batch twins of the streaming operators: the same rules over complete tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import episodes


def runs(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """(key, flag, first, last, n): maximal runs of rows with one flag, as gaps and islands."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, order, flag.alias("flag"))
    new = F.coalesce(F.col("flag") != F.lag("flag").over(w), F.lit(True))
    rows = rows.withColumn("_run", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_run", "flag").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def utterances(frames: DataFrame, key: str, frame: str, speech: Column, start_after: int, end_after: int) -> DataFrame:
    """(key, episode, started, ended): open after so many speech frames in a row, closed after so many silent ones.

    `ended` is null where the stream ends within an utterance.
    """
    long_runs = runs(frames, key, frame, speech).where((F.col("flag") & (F.col("n") >= start_after)) | (~F.col("flag") & (F.col("n") >= end_after)))
    at = F.col("first") + F.when(F.col("flag"), start_after - 1).otherwise(end_after - 1)
    return episodes(long_runs.select(key, "flag", at.alias("at")), [key], "at", F.col("flag"), ~F.col("flag")).select(key, "episode", "started", "ended")


def pause_census(frames: DataFrame, key: str, frame: str, speech: Column) -> DataFrame:
    """(key, first, n, censored): every run of silence; the one that ends the stream is censored."""
    last = Window.partitionBy(key)
    return runs(frames, key, frame, speech).withColumn("censored", F.col("last") == F.max("last").over(last)).where(~F.col("flag")).select(key, "first", "n", "censored")


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.equal_null(x, y) & x.isNotNull())
    return F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda acc, s: F.struct((acc["on"] & s).alias("on"), (acc["n"] + (acc["on"] & s).cast("int")).alias("n")), lambda acc: acc["n"])


def stable_prefix(hypotheses: DataFrame, key: str, seq: str, words: str) -> DataFrame:
    """hypotheses with the number of words that two consecutive ones agree on, never falling."""
    w = Window.partitionBy(key).orderBy(seq)
    agreed = F.coalesce(common_prefix(F.lag(words).over(w), F.col(words)), F.lit(0))
    return hypotheses.withColumn("_a", agreed).withColumn("stable", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")


def claims(codes: DataFrame, attempts: DataFrame, code: str, created: str, at: str, ttl_hours: int) -> DataFrame:
    """attempts with a verdict: the first within the code's lifetime is CLAIMED, later ones are USED, others UNKNOWN or EXPIRED."""
    j = attempts.join(codes.select(code, created), code, "left")
    live = F.col(at).between(F.col(created), F.col(created) + F.make_interval(hours=F.lit(ttl_hours)))
    j = j.withColumn("_live", F.coalesce(live, F.lit(False)))
    first = F.min(F.when(F.col("_live"), F.col(at))).over(Window.partitionBy(code))
    verdict = F.when(F.col(created).isNull(), "UNKNOWN").when(~F.col("_live"), "EXPIRED").when(F.col(at) == first, "CLAIMED").otherwise("USED")
    return j.withColumn("verdict", verdict).drop("_live", created)


def sliding_count(events: DataFrame, key: str, at: str, seconds: int, name: str = "recent") -> DataFrame:
    """events with the number of rows of the key in the last seconds, the row itself included."""
    second = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(at))
    return events.withColumn(name, F.count("*").over(Window.partitionBy(key).orderBy(second).rangeBetween(-seconds * 1_000_000, 0)))


def newest_per_trigger(events: DataFrame, key: str, at: str, trigger: str, value: str) -> DataFrame:
    """(key, trigger, value, n_dropped): of the partials in one trigger only the newest is worked on."""
    return events.groupBy(key, F.date_trunc(trigger, at).cast("timestamp_ntz").alias("trigger")).agg(F.max_by(value, at).alias(value), (F.count("*") - 1).alias("n_dropped"))
