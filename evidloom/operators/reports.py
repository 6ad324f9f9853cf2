"""Record checks, overlapping windows, index percentiles, agreement and subgroup reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .aggregates import wilson


def missing_attribute_questions(df: DataFrame, key: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, field): one question for each field that applies to a record and that it leaves null or empty."""
    asked = F.array(*[F.when(applies & (value.isNull() | (value == "")), F.lit(name)) for name, (applies, value) in fields.items()])
    return df.select(key, F.explode(F.array_compact(asked)).alias("field"))


def import_verdicts(records: DataFrame, batch: str, form: Column, version: Column, valid: Column, expected: tuple[str, int]) -> DataFrame:
    """(batch, verdict, n_imported): a batch is imported whole, or not at all; the first failing check names the reason."""
    g = records.groupBy(batch).agg(F.min(F.coalesce(form == expected[0], F.lit(False))).alias("f"), F.min(F.coalesce(version == expected[1], F.lit(False))).alias("v"), F.min(F.coalesce(valid, F.lit(False))).alias("ok"), F.count("*").alias("n"))
    verdict = F.when(~F.col("f"), "WRONG_FORMAT").when(~F.col("v"), "WRONG_VERSION").when(~F.col("ok"), "INVALID_RECORD").otherwise("IMPORTED")
    return g.select(batch, verdict.alias("verdict"), F.when(verdict == "IMPORTED", F.col("n")).otherwise(0).cast("long").alias("n_imported"))


def window_starts(count: Column, size: int, step: int) -> Column:
    """Where overlapping windows start: every `step` items, the last one moved back to end at the last item."""
    last = count - size
    return F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.concat(F.sequence(F.lit(0).cast("long"), (last - 1).cast("long"), F.lit(step).cast("long")), F.array(last.cast("long"))))


def stitched_tags(windows: Column) -> Column:
    """Tags of a sequence from its overlapping windows, an array of (start, tags) in order.

    Each overlap is cut once, at the place nearest its middle that both sides call
    outside (O), else at the middle; a run that a cut divides keeps the kind it began with.
    """

    def join(acc: Column, w: Column) -> Column:
        start, tags = w["start"], w["tags"]
        middle = F.floor((start + F.size(acc)) / 2)
        places = F.filter(F.sequence(start, F.size(acc) - 1), lambda at: (F.get(acc, at) == "O") & (F.get(tags, at - start) == "O"))
        best = F.array_min(F.transform(places, lambda at: F.struct(F.abs(at - middle).alias("far"), at.alias("at"))))
        cut = F.coalesce(best["at"], middle).cast("int")
        both = F.concat(F.slice(acc, F.lit(1), cut), F.slice(tags, cut - start + 1, F.size(tags)))
        return F.transform(F.array(F.struct(cut.alias("cut"), both.alias("tags"))), _continued)[0]

    def _continued(x: Column) -> Column:
        cut, tags = x["cut"], x["tags"]
        before = F.get(tags, cut - 1)
        end = F.coalesce(F.array_min(F.filter(F.sequence(cut, F.size(tags) - 1), lambda at: ~F.startswith(F.get(tags, at), F.lit("I-")))), F.size(tags))
        moved = F.transform(tags, lambda t, at: F.when((at >= cut) & (at < end), F.concat(F.lit("I-"), F.substr(before, F.lit(3)))).otherwise(t))
        return F.when((cut > 0) & (before != "O"), moved).otherwise(tags)

    return F.aggregate(F.slice(windows, F.lit(2), F.size(windows)), windows[0]["tags"], join)


def access_audit(spark: SparkSession, path: str, rows: int = 1000, separator: str = ",") -> DataFrame:
    """(header, n_columns, n_rows, consistent, readable) of a delimited text: the width of its first rows against its header.

    Only the first `rows` lines are looked at: that is the audit's purpose.
    """
    head = spark.read.text(path).select("value", "_metadata.file_size").limit(rows + 1)
    header = spark.read.text(path).limit(1).select(F.col("value").alias("header"))
    width = lambda c: F.size(F.split(F.col(c), separator))
    both = head.crossJoin(F.broadcast(header))  # one row
    return both.groupBy("header").agg(F.max(width("header")).alias("n_columns"), (F.count("*") - 1).alias("n_rows"), F.bool_and(width("value") == width("header")).alias("consistent"), (F.max("file_size") > 0).alias("readable"))


def index_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, share, value): the value at place int(n * share) of each group's sorted values, counted from 0.

    Works on distinct values and their counts, so a group's rows are never sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    grid = upto.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return grid.where(F.col("_upto") > F.floor(F.col("_all") * F.col("share"))).groupBy(*keys, "share").agg(F.min(value).alias(value))


def index_interval(replicates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, lo, hi): 95 % interval of replicate values by places of the sorted list; replicates are few by definition."""
    s = F.sort_array(F.collect_list(value))
    g = replicates.groupBy(*keys).agg(s.alias("_v")).withColumn("_n", F.size("_v"))
    at = lambda share, less: F.get("_v", (F.floor(F.col("_n") * share) - less).cast("int"))
    return g.select(*keys, at(0.025, 0).alias("lo"), at(0.975, 1).alias("hi"))


def power_table(grid: DataFrame) -> DataFrame:
    """grid (margin, delta, d, n, level) with `power`: that a one-sided test shows a difference below the margin (normal approximation)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from statistics import NormalDist

        normal = NormalDist()
        for b in batches:
            z = ((b["margin"] - b["delta"]) / (b["d"] / b["n"]) ** 0.5).tolist()
            yield b.assign(power=[normal.cdf(x - normal.inv_cdf(1 - a)) for x, a in zip(z, b["level"].tolist(), strict=True)])

    return grid.mapInPandas(run, "margin double, delta double, d double, n long, level double, power double")


def crosscheck(items: DataFrame, candidates: DataFrame, keys: list[str], shown: str) -> DataFrame:
    """items with `agrees`: whether what an item shows is among the candidates of its keys; null where there are none."""
    pairs = candidates.select(*keys, shown).distinct()
    some = pairs.select(*keys).distinct().withColumn("_some", F.lit(True))
    out = items.join(some, keys, "left").join(pairs.withColumn("_hit", F.lit(True)), [*keys, shown], "left")
    return out.select(*items.columns, F.when(F.col("_some"), F.coalesce("_hit", F.lit(False))).alias("agrees"))


def supported_edges(evidence: DataFrame, edge: list[str], source: Column, flags: dict[str, Column]) -> DataFrame:
    """(edge, n_sources, flags): how many sources support an edge, and every review flag whose aggregate condition holds."""
    g = evidence.groupBy(*edge).agg(F.count_distinct(source).alias("n_sources"), *[c.alias(f"_{k}") for k, c in flags.items()])
    kept = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in flags]))
    return g.select(*edge, "n_sources", F.array_join(kept, ";").alias("flags"))


def stress_set(differential: DataFrame, case: str, truth: str, name: str, order: list[str]) -> DataFrame:
    """(case, truth, working): the best alternative that is not the truth; cases without one are left out."""
    return differential.where(F.col(name) != F.col(truth)).groupBy(case, truth).agg(F.min_by(name, F.struct(*order)).alias("working"))


def coin_mixture(pairs: DataFrame, case: str, first: str, second: str, shares: list[float], coin) -> DataFrame:
    """(share, n, rate): of each complete pair the first value with probability `share`, by the coin of the case, else the second."""
    full = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    each = full.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    pick = F.when(coin(F.col("share"), F.col(case)) < F.col("share"), F.col(first)).otherwise(F.col(second))
    return each.groupBy("share").agg(F.count("*").alias("n"), F.round(F.avg(pick.cast("double")), 8).alias("rate"))


def agreement(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(n, agreement) on the keys of both; null without any."""
    return a.select(key, left).join(b.select(key, right), key).agg(F.count("*").alias("n"), F.round(F.avg((F.col(left) == F.col(right)).cast("double")), 8).alias("agreement"))


def edge_precision_recall(found: DataFrame, reference: DataFrame, edge: list[str]) -> DataFrame:
    """(n_found, n_reference, n_both, precision, recall) of two edge sets, from one aggregate over their union."""
    both = found.select(*edge, F.lit(1).alias("f"), F.lit(0).alias("r")).unionByName(reference.select(*edge, F.lit(0).alias("f"), F.lit(1).alias("r")))
    g = both.groupBy(*edge).agg(F.max("f").alias("f"), F.max("r").alias("r")).agg(F.sum("f").alias("n_found"), F.sum("r").alias("n_reference"), F.sum(F.col("f") * F.col("r")).alias("n_both"))
    share = lambda n: F.round(F.try_divide(F.col("n_both"), F.col(n)), 8)
    return g.select("n_found", "n_reference", "n_both", share("n_found").alias("precision"), share("n_reference").alias("recall"))


def subgroup_rows(df: DataFrame, dimensions: list[str], hit: str) -> DataFrame:
    """(dimension, value, n, hits, rate, lo, hi): one row for each value of each dimension, by grouping sets in one pass."""
    g = df.groupingSets([[c] for c in dimensions], *dimensions).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), *[F.grouping(c).alias(f"_{c}") for c in dimensions])
    name = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in dimensions])
    value = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")) for c in dimensions])
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return g.select(name.alias("dimension"), value.alias("value"), "n", "hits", F.round(F.col("hits") / F.col("n"), 8).alias("rate"), F.round(lo, 8).alias("lo"), F.round(hi, 8).alias("hi"))


def ratio_of_sums(df: DataFrame, keys: list[str], hits: Column, events: Column) -> DataFrame:
    """(keys, rate): all hits over all events of a group, not a mean of ratios; null without events."""
    return df.groupBy(*keys).agg(F.round(F.try_divide(F.sum(hits), F.sum(events)), 8).alias("rate"))
