"""Greedy choice of spans that do not overlap, without a key's spans in one row or one loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cut


def next_starts(one: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(keys, a, b, next): the smallest start of the same key that is at or after the span's end, or null.

    Positions are cut into slots of a width.  A span looks through its end's slot;
    only where no start is left there does it take the first one of the next slot
    that has any, so a window holds the spans of one slot, or one row a slot.
    """
    slot = lambda c: F.floor(F.col(c) / F.lit(width)).alias("_slot")
    none = F.lit(None).cast(one.schema["a"].dataType)
    starts = one.select(*keys, slot("a"), F.col("a").alias("_at"), F.col("a").alias("_start"), none.alias("a"), none.alias("b"))
    ends = one.select(*keys, slot("b"), F.col("b").alias("_at"), none.alias("_start"), "a", "b")
    points = starts.unionByName(ends)
    # From the right: starts at a place come before the ends that look for one.
    here = Window.partitionBy(*keys, "_slot").orderBy(F.desc("_at"), F.desc_nulls_last("_start")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = points.groupBy(*keys, "_slot").agg(F.min("_start").alias("_first")).withColumn("_later", F.min("_first").over(later)).drop("_first")
    found = points.withColumn("_here", F.min("_start").over(here)).where("b is not null")
    return found.join(slots, [*keys, "_slot"]).select(*keys, "a", "b", F.coalesce("_here", "_later").alias("next"))


def greedy_spans(spans: DataFrame, keys: list[str], start: str, end: str, width: float) -> DataFrame:
    """(keys, start, end) of the chosen spans: leftmost, then longest, each at or after the end of the one before.

    Every span points at the one that would follow it; from each key's first span,
    pointers of 1, 2, 4, ... steps mark what is reached, so rounds grow with the
    logarithm of the longest choice.  Spans with a null key, start or end, and those
    that end at or before their start, take no part; repeats count once; an empty
    table gives an empty result; other columns are ignored.  `width` should span some
    thousand spans of the busiest key.
    """
    s = spans.select(*keys, F.col(start).alias("a"), F.col(end).alias("b")).where("b > a").dropna(subset=keys)
    one = cut(s.groupBy(*keys, "a").agg(F.max("b").alias("b")))
    step = cut(next_starts(one, keys, width).where("next is not null").select(*keys, "a", "next"))
    reached = cut(one.groupBy(*keys).agg(F.min("a").alias("a")))
    while True:
        more = cut(reached.join(step, [*keys, "a"]).select(*keys, F.col("next").alias("a")))
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        step = cut(step.join(step.select(*keys, F.col("a").alias("next"), F.col("next").alias("_far")), [*keys, "next"]).select(*keys, "a", F.col("_far").alias("next")))
    return one.join(reached, [*keys, "a"]).select(*keys, F.col("a").alias(start), F.col("b").alias(end))
