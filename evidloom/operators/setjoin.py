"""Similarity join of sets: all pairs of a Jaccard similarity or more, by prefix, length and positional filters.

Items are ordered by how many sets hold them, the rarest first.  Two sets that are
similar enough share an item among the first few of either, so only those are
joined: common items lie behind every prefix but that of sets made of them alone.
Pairs whose sizes, whose places of the shared item, or whose sketches rule the
similarity out leave where they meet, before any pair is shuffled or any set is
compared: 512 bits tell sets of some hundred items apart.  What meets still grows
with the square of an item's prefixes, what is shuffled with the input and the result.  Equal sets are one: pairs are between their
smallest ids, and `set_classes` tells who belongs to whom.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_classes(df: DataFrame, id_col: str, items: str) -> DataFrame:
    """(id, items, rep): each row with the smallest id whose set is equal; items in order, each once. Null and empty sets, and null ids, are left out."""
    own = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.array_compact(items))).alias("items")).where((F.size("items") > 0) & F.col("id").isNotNull())
    reps = own.groupBy("items").agg(F.min("id").alias("rep"))
    return own.join(reps, "items").select("id", "items", "rep")


def _distinct_sets(df: DataFrame, id_col: str, items: str) -> DataFrame:
    own = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.array_compact(items))).alias("items")).where((F.size("items") > 0) & F.col("id").isNotNull())
    return own.groupBy("items").agg(F.min("id").alias("id"))


#: Longs of 64 bits that sketch a set.
SKETCH_LONGS = 8


def _ordered(sets: DataFrame, often: DataFrame) -> DataFrame:
    """(id, n, ordered, sketch_0, ...): each set's items as (count, hash), the rarest first, and its sketch.

    Every item flips one of the sketch's bits, so two sketches differ in no more bits than the sets in items.
    Items of one count and hash pass for one here, which can only let more pairs meet.
    """
    each = sets.select("id", F.explode("items").alias("item")).join(often, "item").select("id", "often", F.xxhash64("item").alias("h"))
    flips = [F.expr(f"coalesce(bit_xor(CASE WHEN (shiftrightunsigned(h, 6) & {SKETCH_LONGS - 1}) = {k} THEN shiftleft(1L, CAST(h & 63 AS INT)) END), 0L)").alias(f"sketch_{k}") for k in range(SKETCH_LONGS)]
    return each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("ordered"), *flips).withColumn("n", F.size("ordered"))


def _prefixes(ordered: DataFrame, percent: int) -> DataFrame:
    """(id, n, sketch_0, ..., place, item): the items of which one at least is shared with any set that is similar enough."""
    length = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    sketch = [f"sketch_{k}" for k in range(SKETCH_LONGS)]
    each = ordered.select("id", "n", *sketch, F.posexplode(F.slice("ordered", F.lit(1), length.cast("int"))).alias("place", "_x"))
    return each.select("id", "n", *sketch, "place", F.col("_x.h").alias("item"))


def candidates(left: DataFrame, right: DataFrame, percent: int, same: bool) -> DataFrame:
    """(a, b, n_a, n_b) of ordered sets that the filters leave; they judge a pair where it meets, so that only what is left is shuffled."""
    one = _prefixes(left, percent)
    two = one if same else _prefixes(right, percent)  # one exchange serves both sides of a join with itself
    met = one.alias("l").join(two.alias("r"), F.col("l.item") == F.col("r.item"))
    if same:
        met = met.where("l.id < r.id")
    least = f"(({percent} * (l.n + r.n) + {99 + percent}) div {100 + percent})"
    met = met.where(f"100 * l.n >= {percent} * r.n and 100 * r.n >= {percent} * l.n").where(f"least(l.n - l.place, r.n - r.place) >= {least}")
    apart = " + ".join(f"bit_count(l.sketch_{k} ^ r.sketch_{k})" for k in range(SKETCH_LONGS))
    met = met.where(f"{apart} <= l.n + r.n - 2 * {least}")
    return met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.n").alias("n_a"), F.col("r.n").alias("n_b")).distinct()


def similar_sets(left: DataFrame, right: DataFrame | None, id_col: str, items: str, percent: int, right_id: str | None = None, right_items: str | None = None) -> DataFrame:
    """(a, b, n_a, n_b, n_both) of all pairs of sets with 100 * n_both >= percent * (n_a + n_b - n_both).

    Without `right`, pairs a < b within `left`.  Ids are of any type that can be
    ordered, and name one set each; of equal sets of a side the smallest id
    stands for all.  Null items and repeats count for nothing; null and empty sets
    are similar to nothing; other columns are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    one = _distinct_sets(left, id_col, items)
    two = one if right is None else _distinct_sets(right, right_id or id_col, right_items or items)
    held = one if right is None else one.unionByName(two)
    often = held.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("often"))
    ordered = _ordered(one, often)
    found = candidates(ordered, ordered if right is None else _ordered(two, often), percent, right is None)
    full = found.join(one.select(F.col("id").alias("a"), F.col("items").alias("_of_a")), "a").join(two.select(F.col("id").alias("b"), F.col("items").alias("_of_b")), "b")
    full = full.withColumn("n_both", F.size(F.array_intersect("_of_a", "_of_b")))
    return full.where(f"100 * n_both >= {percent} * (n_a + n_b - n_both)").select("a", "b", "n_a", "n_b", "n_both")
