"""Graphs as edge tables: closures, components, three-valued rules, support."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or a temporary one where a local session names none (one machine)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="evidloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that the plan of a loop stays short and lost executors cost no restart."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


class Levels:
    """Frames of one schema, each written once as Parquet in the checkpoint folder, and read as one table.

    Parquet takes a fraction of a checkpoint's room, and the files of many levels
    are packed into few tasks, where a union would bring those of every level.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        """The frame as it was written."""
        path = f"{checkpoint_folder(df.sparkSession)}/levels-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        self._read = df.sparkSession.read.schema(df.schema)
        return self._read.parquet(path)

    def all(self) -> DataFrame:
        return self._read.parquet(*self.paths)


def stored(df: DataFrame) -> DataFrame:
    return Levels().add(df)


#: Edges, or rows of a round, up to which they may be sent to every task (16 bytes each).
BROADCAST_EDGES = 200_000
#: Nodes of a block (as a power of two), its edges up to which one task takes them, and the (node, ancestor) cells that are marked at once.
BLOCK_BITS, BLOCK_EDGES, CELLS = 11, 2_000_000, 1 << 22


def _edges(edges: DataFrame, child: str, parent: str) -> DataFrame:
    return stored(edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).distinct())


def closure(edges: DataFrame, child: str, parent: str, start: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(node, ancestor, depth): every ancestor with its smallest depth, at most `most` if given; from the nodes of `start` only if given.

    Without `start`, the edges above each block of nodes are gathered, and pairs are
    found inside the blocks when they are read, so none is shuffled or written.
    Both ways end on graphs with cycles too.
    """
    e = _edges(edges, child, parent)
    if start is not None:
        return _walked(e, start, most)
    return _pairs(e, *blocks_above(e, most), most)


def _walked(e: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """The pairs of some nodes, breadth-first by joins: a round joins only the newest pairs with the edges and drops those that are known.

    Each level is written once.  Edges are counted, as the size of their file says
    little: only few rows are broadcast, others are joined by shuffles.
    """
    few, levels = e.count() <= BROADCAST_EDGES, Levels()
    start = start.select(F.col(start.columns[0]).alias("_s")).distinct()
    new = e.join(start, F.col("_c").eqNullSafe(F.col("_s")), "left_semi").select(F.col("_c").alias("node"), F.col("_p").alias("ancestor"))
    depth = 1
    while True:
        new = levels.add(new.distinct().withColumn("depth", F.lit(depth)))
        if depth == most or new.isEmpty():
            return levels.all()
        known = levels.all().select(F.col("node").alias("_n"), F.col("ancestor").alias("_a")).hint("merge")
        new = new.join(F.broadcast(e) if few else e.hint("merge"), F.col("ancestor") == F.col("_c")).select("node", F.col("_p").alias("ancestor"))
        new = new.join(known, F.col("node").eqNullSafe(F.col("_n")) & F.col("ancestor").eqNullSafe(F.col("_a")), "left_anti")
        depth += 1


def blocks_above(e: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """((block, _c, _p, first), large): the edges (_c, _p) above each block of nodes that follow each other in order.

    `first` marks the edges of the block's own nodes; `large` names the blocks of
    over BLOCK_EDGES edges, if there are any.  A round takes the edges of those
    nodes that a block has reached last, so what moves is a row for each block and
    node, where neighbours share most of their ancestors, and not one for each pair.
    """
    few, above, reached = e.count() <= BROADCAST_EDGES, Levels(), Levels()
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    new = reached.add(e.select(F.col("_c").alias("_n")).distinct().orderBy("_n").select(block.alias("block"), "_n"))
    rows, depth = None, 1
    while True:
        small = rows is not None and rows <= BROADCAST_EDGES
        on = F.col("_n").eqNullSafe(F.col("_c")) if depth == 1 else F.col("_n") == F.col("_c")
        step = F.broadcast(new).join(e, on) if small else new.join(F.broadcast(e) if few else e.hint("merge"), on)
        level = above.add(step.select("block", "_c", "_p", F.lit(depth == 1).alias("first")))
        rows = level.count()
        if rows == 0 or depth == most:
            break
        known, new = reached.all(), level.where("_p is not null").select("block", F.col("_p").alias("_n")).distinct()
        known = F.broadcast(known.join(F.broadcast(new), ["block", "_n"], "left_semi")) if rows <= BROADCAST_EDGES else known.hint("merge")
        new = reached.add(new.join(known, ["block", "_n"], "left_anti"))
        depth += 1
    found = above.all()
    large = cut(found.groupBy("block").count().where(F.col("count") > BLOCK_EDGES).select("block"))
    return found, None if large.isEmpty() else large


def _parted(above: DataFrame, large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The blocks for tasks, and the nodes of those that are too large for one, whose pairs are walked."""
    if large is None:
        return above, None
    return above.join(large, "block", "left_anti"), above.where("first").join(large, "block", "left_semi").select("_c").distinct()


def _pairs(e: DataFrame, above: DataFrame, large: DataFrame | None, most: int | None = None) -> DataFrame:
    above, rest = _parted(above, large)
    kind = {f.name: f.dataType.simpleString() for f in e.schema}
    found = above.groupBy("block").applyInArrow(_pairs_of(most), f"node {kind['_c']}, ancestor {kind['_p']}, depth int")
    return found if rest is None else found.unionByName(_walked(e, rest, most))


def _reached(rows: pa.Table, most: int | None = None) -> tuple[pa.Array, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The nodes of a block, and its pairs as (node, ancestor, depth) by their numbers, in parts of about CELLS cells."""
    both = pa.chunked_array([*rows["_c"].chunks, *rows["_p"].chunks], rows["_c"].type).combine_chunks().dictionary_encode(null_encoding="encode")
    names, code = both.dictionary, both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = names.is_valid().to_numpy(zero_copy_only=False)
    order = np.argsort(code[: len(rows)], kind="stable")
    parent = code[len(rows) :][order]
    begin = np.searchsorted(code[: len(rows)][order], np.arange(len(names) + 1))
    own = np.unique(code[: len(rows)][rows["first"].to_numpy()])

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        take = max(1, CELLS // max(1, len(names)))
        for k in range(0, len(own), take):
            mine = own[k : k + take]
            seen = np.zeros(len(mine) * len(names), dtype=bool)
            row, at, out, depth = np.arange(len(mine)), mine, [], 1
            while len(at) and (most is None or depth <= most):
                times = begin[at + 1] - begin[at]
                edge = np.arange(times.sum()) + np.repeat(begin[at] - np.cumsum(times) + times, times)
                cell = np.unique(np.repeat(row, times) * len(names) + parent[edge])
                cell = cell[~seen[cell]]
                seen[cell] = True
                row, at = cell // len(names), cell % len(names)
                out.append((mine[row], at, np.full(len(at), depth, dtype=np.int32)))
                row, at, depth = row[real[at]], at[real[at]], depth + 1
            yield tuple(np.concatenate([x[j] for x in out]) for j in range(3))

    return names, parts()


def _pairs_of(most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = _reached(pa.Table.from_batches(batches), most)
        for node, ancestor, depth in parts:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(node)), names.take(pa.array(ancestor)), pa.array(depth)], names=["node", "ancestor", "depth"])

    return run


def specificity(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, specificity): the sum of 1 / n over a node's ancestors, where n nodes have that ancestor.

    Pairs are counted and added up where they are found; only the counts move, to
    the blocks that have their ancestor.
    """
    e = _edges(edges, child, parent)
    above, large = blocks_above(e)
    n = stored(_pairs(e, above, large).where("ancestor is not null").groupBy("ancestor").agg(F.count("*").alias("n"))).hint("merge")
    above, rest = _parted(above, large)
    counted = above.join(n, F.col("_p") == F.col("ancestor"), "left").select("block", "_c", "_p", "first", "n")
    found = counted.groupBy("block").applyInArrow(_sums_of, f"node {e.schema['_c'].dataType.simpleString()}, specificity double")
    if rest is None:
        return found
    return found.unionByName(_walked(e, rest).join(n, "ancestor").groupBy("node").agg(F.sum(1.0 / F.col("n")).alias("specificity")))


def _sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    names, parts = _reached(rows)
    part = np.zeros(len(names))
    counted = rows.filter(rows["n"].is_valid())
    at = pc.index_in(counted["_p"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
    part[at] = 1.0 / counted["n"].to_numpy()
    for node, ancestor, _ in parts:
        node, ancestor = node[part[ancestor] > 0], ancestor[part[ancestor] > 0]
        mine, place = np.unique(node, return_inverse=True)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(mine)), pa.array(np.bincount(place, weights=part[ancestor], minlength=len(mine)))], names=["node", "specificity"])


def carried_up(records: DataFrame, edges: DataFrame, key: str, node: str, child: str, parent: str) -> DataFrame:
    """(key, up): for each record, the ancestors of its node in order, as one array; records of nodes without any are left out.

    Records go to their node's block, so that an ancestor moves on as 8 bytes of an array and not as a row.
    """
    e = _edges(edges, child, parent)
    above, large = blocks_above(e)
    nodes = above.where("first").select("block", "_c").distinct().hint("merge")
    asked = records.select(F.col(key).alias("key"), F.col(node).alias("_c"))
    small, rest = _parted(above, large)
    kinds = {f.name: f.dataType for f in asked.schema}
    none = lambda kind: F.lit(None).cast(kind)
    asked_in = asked.join(nodes, "_c").select("block", "_c", none(e.schema["_p"].dataType).alias("_p"), F.lit(False).alias("first"), "key", F.lit(True).alias("asks"))
    if large is not None:
        asked_in = asked_in.join(large, "block", "left_anti")
    both = small.select("block", "_c", "_p", "first", none(kinds["key"]).alias("key"), F.lit(False).alias("asks")).unionByName(asked_in)
    found = both.groupBy("block").applyInArrow(_arrays_of, f"key {kinds['key'].simpleString()}, up array<{e.schema['_p'].dataType.simpleString()}>").withColumnRenamed("key", key)
    if rest is None:
        return found
    walked = _walked(e, rest).hint("merge")
    return found.unionByName(asked.join(walked, F.col("_c") == F.col("node")).select(F.col("key").alias(key), F.array("ancestor").alias("up")))


#: Ancestors in a batch of arrays, about.
BATCH_VALUES = 1 << 20


def _arrays_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    asked, rows = rows.filter(rows["asks"]), rows.filter(pc.invert(rows["asks"]))
    names, parts = _reached(rows)
    rank = np.empty(len(names), dtype=np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    who = pc.index_in(asked["_c"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
    order = np.argsort(who, kind="stable")
    who, keys = who[order], asked["key"].combine_chunks()
    for node, ancestor, _ in parts:
        by = np.lexsort((rank[ancestor], node))
        node, ancestor = node[by], ancestor[by]
        lo, hi = np.searchsorted(who, node[0]), np.searchsorted(who, node[-1], "right")
        size = np.searchsorted(node, who[lo:hi], "right") - (first := np.searchsorted(node, who[lo:hi]))
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // BATCH_VALUES)) + 1
        for a, b in zip([0, *cuts], [*cuts, hi - lo], strict=True):
            offset = np.concatenate([[0], np.cumsum(size[a:b])])
            value = np.arange(offset[-1]) + np.repeat(first[a:b] - offset[:-1], size[a:b])
            up = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), names.take(pa.array(ancestor[value])))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(order[lo + a : lo + b])), up], names=["key", "up"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large-star and small-star rounds.

    Rounds grow with the logarithm of the longest path.  The edges of a hot node,
    of which there are at most HOT_NODES by their share, are dealt over all partitions.
    """
    e = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    last, n = None, e.count()
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = cut(_with_lowest(both.where("b > a"), low, 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_lowest(large, low, n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last, n = now, now[0]
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: A node with more than one edge in so many is hot.
HOT_NODES = 1000


def _with_lowest(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """edges (a, b) with the `m` of their a; edges of hot nodes are salted by b."""
    salts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col("n") > max(total / HOT_NODES, 1.0)
    few = low.where(hot).select("a", F.lit(True).alias("_hot"))
    salted = edges.join(F.broadcast(few), "a", "left").select("a", "b", F.when(F.col("_hot"), F.pmod(F.xxhash64("b"), F.lit(salts))).otherwise(0).cast("int").alias("_salt"))
    spread = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return salted.join(low.select("a", "m", spread.alias("_salt")), ["a", "_salt"]).select("a", "b", "m")


def at_least(df: DataFrame, keys: list[str], verdict: str, k: Column) -> DataFrame:
    """(keys, verdict) of a k-of-n rule over true, false and null (undetermined) parts."""
    sat, und = F.count_if(verdict), F.count_if(F.col(verdict).isNull())
    out = df.groupBy(*keys).agg(sat.alias("_s"), und.alias("_u"), F.max(k).alias("_k"))
    return out.select(*keys, F.when(F.col("_s") >= F.col("_k"), True).when(F.col("_s") + F.col("_u") < F.col("_k"), False).alias(verdict))


def combined(df: DataFrame, keys: list[str], op: str, verdict: str) -> DataFrame:
    """(keys, verdict) of AND and OR rules in Kleene logic: an undetermined part matters unless the rest decides."""
    yes, no, unknown = F.count_if(verdict), F.count_if(~F.col(verdict)), F.count_if(F.col(verdict).isNull())
    all_of = F.when(no > 0, False).when(unknown > 0, None).when(yes > 0, True)
    any_of = F.when(yes > 0, True).when(unknown > 0, None).when(no > 0, False)
    return df.groupBy(*keys).agg(F.when(F.first(op) == "AND", all_of).otherwise(any_of).alias(verdict))


def leaf_verdict(status: Column, value: Column, unit: Column, op: Column, bound: Column, bound_unit: Column) -> Column:
    """A leaf condition: by status, and by threshold where one is set; null if it cannot be told."""
    compared = F.when(op == ">=", value >= bound).when(op == "<", value < bound)
    measured = F.when(unit.isNull() | (unit != bound_unit), None).otherwise(compared)
    return F.when(status == "NEGATIVE", False).when(status != "POSITIVE", None).when(op.isNull(), True).otherwise(measured)


#: Rows of a round of paths up to which they may be sent to every task.
BROADCAST_PATHS = 20_000


def first_shortest_paths(edges: DataFrame, keep: str = "true", root: int = 0) -> DataFrame:
    """(node, path): the shortest way from each kept child to the root, the first by string order.

    Found downwards from the root: a node's first shortest path is its own name
    before the first path of those parents that are one level nearer, so every
    node has one path and meets it once.  A round joins only the newest level, so
    cycles end; nodes that never reach the root have no row.  Levels are read as
    one table, so tasks grow with what was written and not with the rounds; the
    driver is sent a level only while it is of few rows.
    """
    text = lambda c: F.col(c).cast("string")
    e = _edges(edges.where("child is not null and parent is not null"), "child", "parent")
    few, levels = e.count() <= BROADCAST_EDGES, Levels()
    new = e.where(F.col("_p") == root).select(F.col("_c").alias("node"), F.concat_ws(">", text("_c"), F.lit(root).cast("string")).alias("path"))
    while True:
        new = levels.add(new)
        rows = new.count()
        if rows == 0:
            break
        small = rows <= BROADCAST_PATHS
        step = e.join(F.broadcast(new), F.col("_p") == F.col("node")) if small else (F.broadcast(e) if few else e.hint("merge")).join(new.hint("merge"), F.col("_p") == F.col("node"))
        step = step.select("_c", F.concat_ws(">", text("_c"), "path").alias("path"))
        step = step.join(levels.all().select("node").hint("merge"), F.col("_c") == F.col("node"), "left_anti")
        new = step.groupBy(F.col("_c").alias("node")).agg(F.min("path").alias("path"))
    found = levels.all()
    return found.join(edges.where(keep).select(F.col("child").alias("node")).distinct(), "node", "left_semi") if keep != "true" else found
