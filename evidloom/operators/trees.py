"""Decision trees grown level by level: one aggregate gives the histograms of all open nodes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import cut


@dataclass
class Tree:
    """Nodes by heap number: the children of node i are 2 * i and 2 * i + 1; a row goes to the second if its feature is above the threshold."""

    features: list[str]
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    labels: dict[int, object] = field(default_factory=dict)


def thresholds(df: DataFrame, feature: str, bins: int) -> list[float]:
    """Where a feature may be cut: at all its values but the largest if there are at most `bins`, else at its quantiles."""
    x = df.select(F.col(feature).cast("double").alias("x")).where("x is not null and not isnan(x)")
    values = sorted(r["x"] for r in x.distinct().limit(bins + 1).collect())
    if len(values) > bins:
        values = sorted(set(x.agg(F.percentile_approx("x", [i / bins for i in range(1, bins + 1)], 10_000).alias("q")).first()["q"]))
    return values[:-1]


def _entropy(n: np.ndarray) -> np.ndarray:
    """Entropy in bits of the counts along the last axis, times their sum."""
    total = n.sum(axis=-1, keepdims=True)
    share = np.divide(n, total, out=np.zeros(n.shape), where=total > 0)
    return -(n * np.log2(share, out=np.zeros(n.shape), where=share > 0)).sum(axis=-1)


def _best_cut(least: int):
    """The best cut of one feature in one node from its histogram, if both sides hold `least` rows."""

    def run(h: pd.DataFrame) -> pd.DataFrame:
        counts = h.pivot_table(index="bin", columns="y", values="n", aggfunc="sum", fill_value=0).sort_index()
        left = counts.to_numpy(float).cumsum(axis=0)
        both = left[-1]
        gain = np.round((_entropy(both) - _entropy(left) - _entropy(both - left)) / both.sum(), 12)
        size = left.sum(axis=1)
        gain[(size < least) | (both.sum() - size < least)] = -1.0
        at = int(gain.argmax())
        kept = gain[at] > 0
        return pd.DataFrame({"node": h["node"].iloc[:1], "f": h["f"].iloc[:1], "cut": [int(counts.index[at])], "gain": [gain[at]]})[: int(kept)]

    return run


def fit_tree(df: DataFrame, features: list[str], label: str, depth: int = 10, least: int = 50, bins: int = 64) -> Tree:
    """A tree by information gain (entropy), of at most `depth` levels and leaves of at least `least` rows.

    Rows are cut into bins and counted once; a level sums the counts of all its open
    nodes by (node, feature, bin, label), so what is shuffled is bounded by the tree and
    not by the rows.  The driver holds the tree: at most 2 ** depth cuts.  Gains are
    rounded to 12 places; ties go to the earlier feature, then the smaller threshold.
    Rows with a null label are left out; a null feature is below, NaN above all
    thresholds; no rows give a tree whose label is null.
    """
    df = df.where(F.col(label).isNotNull())
    cuts = [thresholds(df, f, bins) for f in features]
    place = lambda f, t: F.size(F.filter(F.array(*map(F.lit, t)).cast("array<double>"), lambda c: c < F.col(f).cast("double")))
    binned = F.array(*[F.when(F.col(f).isNull(), 0).otherwise(place(f, t)) if t else F.lit(0) for f, t in zip(features, cuts, strict=True)])
    cells = cut(df.select(binned.alias("b"), F.col(label).alias("y")).groupBy("b", "y").agg(F.count("*").alias("n"))).withColumn("node", F.lit(1).cast("long"))
    spark, tree, start = df.sparkSession, Tree(features), 1

    def name_leaves() -> None:
        by = cells.groupBy("node", "y").agg(F.sum("n").alias("n")).groupBy("node").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("y"))
        tree.labels |= {r["node"]: r["y"] for r in by.collect()}

    name_leaves()
    for _ in range(depth):
        each = cells.where(F.col("node") >= start).select("node", "y", "n", F.posexplode("b").alias("f", "bin"))
        hist = each.groupBy("node", "f", "bin", "y").agg(F.sum("n").alias("n"))
        found = hist.groupBy("node", "f").applyInPandas(_best_cut(least), "node long, f int, cut int, gain double")
        best = found.groupBy("node").agg(F.min_by(F.struct("f", "cut"), F.struct(-F.col("gain"), F.col("f"), F.col("cut"))).alias("s")).select("node", "s.f", "s.cut").collect()
        if not best:
            break
        tree.splits |= {r["node"]: (r["f"], cuts[r["f"]][r["cut"]]) for r in best}
        # At most 2 ** depth rows.
        splits = F.broadcast(spark.createDataFrame([tuple(r) for r in best], "node long, f int, cut int"))
        down = F.when(F.col("f").isNotNull(), F.col("node") * 2 + (F.element_at("b", F.col("f") + 1) > F.col("cut")).cast("long")).otherwise(F.col("node"))
        cells = cut(cells.join(splits, "node", "left").select("b", "y", "n", down.alias("node")))
        start *= 2
        name_leaves()
    return tree


def predicted(tree: Tree, rows: DataFrame, name: str, kind: str) -> DataFrame:
    """rows with the label of the leaf that each reaches; the tree is one row of arrays that every task has."""
    top = max(tree.labels, default=1) + 1
    at = lambda d, none: [d.get(i, none) for i in range(1, top)]
    f, t = at({i: s[0] + 1 for i, s in tree.splits.items()}, 0), at({i: s[1] for i, s in tree.splits.items()}, 0.0)
    arrays = rows.sparkSession.createDataFrame([(f, t, at(tree.labels, None))], f"_f array<int>, _t array<double>, _y array<{kind}>")
    x = F.array(*[F.col(c).cast("double") for c in tree.features])
    steps = F.sequence(F.lit(1), F.lit(max(1, top.bit_length())))

    def down(node: Column, _: Column) -> Column:
        own = F.element_at("_f", node)
        above = F.coalesce(F.element_at("_x", F.greatest(own, F.lit(1))) > F.element_at("_t", node), F.lit(False))
        return F.when(own > 0, node * 2 + above.cast("int")).otherwise(node)

    out = rows.withColumn("_x", x).crossJoin(F.broadcast(arrays))  # one row
    return out.withColumn(name, F.element_at("_y", F.aggregate(steps, F.lit(1), down))).drop("_x", "_f", "_t", "_y")
