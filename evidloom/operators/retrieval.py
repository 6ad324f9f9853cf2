"""Preselection by shared tokens over inverted lists, and a second ranking by character grams."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cut
from .topk import top_k

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def postings(df: DataFrame, id_col: str, tokens: Column, name: str) -> DataFrame:
    """(name, t, n): how often each row has each token; null ids and null or empty tokens are left out."""
    each = df.select(F.col(id_col).alias(name), F.explode(tokens).alias("t")).where(F.col(name).isNotNull() & F.col("t").isNotNull() & (F.col("t") != ""))
    return each.groupBy(name, "t").agg(F.count("*").alias("n"))


def _shared(a: str, b: str) -> Column:
    """Sum of products of the counts of the tokens that two arrays of (t, n) share; 0 where one is null."""
    return F.expr(f"coalesce(aggregate({a}, 0L, (z, x) -> z + aggregate({b}, 0L, (y, w) -> y + IF(w.t = x.t, w.n * x.n, 0L))), 0L)")


def most_shared(asked: DataFrame, held: DataFrame, k: int, hot: int = 4_000, same: bool = False) -> DataFrame:
    """(query_id, id, n): for each query the k rows of largest overlap n, the sum of products of token counts; ties to the smaller id.

    asked: (query_id, t, n) and held: (id, t, n) as `postings` gives them; with `same`
    a query never finds its own id.  Rows without a shared token are not found.

    Tokens that at most `hot` rows hold are joined as inverted lists.  A row that
    shares none of them has at most a query's bound over its hot tokens; a query
    with k rows above that bound is settled.  For the others, rows are looked up by
    their whole sets of hot tokens: the best such sets that hold k rows between
    them, and of each its k first ids, hold whatever may still be among the best.
    So no list of a hot token is ever joined with the queries.
    """
    k_all = k + same
    asked, held = cut(asked), cut(held)
    common = held.groupBy("t").agg(F.count("*").alias("_df"), F.max("n").alias("most")).where(F.col("_df") > hot).drop("_df")
    common = cut(common)
    bag = F.sort_array(F.collect_list(F.struct("t", "n")))
    held_hot = cut(held.join(common, "t").groupBy("id").agg(bag.alias("b")))
    asked_hot = cut(asked.join(common, "t").groupBy("query_id").agg(bag.alias("a"), F.sum(F.col("n") * F.col("most")).alias("bound")))
    met = asked.join(held.join(common, "t", "left_anti").withColumnRenamed("n", "m"), "t").groupBy("query_id", "id").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    met = met.join(asked_hot.select("query_id", "a"), "query_id", "left").join(held_hot, "id", "left")
    met = cut(met.select("query_id", "id", (F.col("n") + _shared("a", "b")).alias("n")))
    settled = met.join(asked_hot.select("query_id", "bound"), "query_id").where("n > bound").groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= k_all)
    still = cut(asked_hot.join(settled, "query_id", "left_anti").select("query_id", "a"))
    # Equal sets of hot tokens are one on either side.
    sets = held_hot.groupBy("b").agg(F.count("*").alias("rows"))
    near = still.select("a").distinct().select("a", F.explode("a.t").alias("t")).join(sets.select("b", "rows", F.explode("b.t").alias("t")), "t").select("a", "b", "rows").distinct()
    near = cut(near.withColumn("n", _shared("a", "b")))
    before = F.sum("_rows").over(Window.partitionBy("a").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    levels = near.groupBy("a", "n").agg(F.sum("rows").alias("_rows")).withColumn("_before", before).where(F.coalesce("_before", F.lit(0)) < k_all).select("a", "n")
    first = top_k(held_hot, ["b"], [F.asc("id")], k_all)
    found = still.join(near.join(levels, ["a", "n"]).select("a", "b", "n"), "a").join(first, "b").select("query_id", "id", "n")
    out = met.unionByName(found).groupBy("query_id", "id").agg(F.max("n").alias("n"))
    return top_k(out.where("query_id <> id") if same else out, ["query_id"], [F.desc("n"), F.asc("id")], k)


def gram_counts(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(id, v): hashes of a text's runs of `size` characters in order, each with its count; blanks stand before and after a text.

    Counted inside the row from the ends of equal stretches of the sorted hashes, so nothing is shuffled.
    """
    t = F.concat(F.lit(" "), F.col(text), F.lit(" "))
    places = F.when(F.length(t) >= size, F.sequence(F.lit(1), F.length(t) - size + 1)).otherwise(F.array().cast("array<int>"))
    hashes = F.array_sort(F.transform(places, lambda i: F.xxhash64(F.substring(t, i, F.lit(size)))))
    one = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  bound once
    starts = lambda h: F.filter(F.transform(h, lambda x, i: F.when((i == 0) | (F.get(h, i - 1) != x), i)), lambda i: i.isNotNull())
    runs = one(hashes, lambda h: one(starts(h), lambda st: F.transform(st, lambda x, j: F.struct(F.get(h, x).alias("g"), (F.coalesce(F.get(st, j + 1), F.size(h)) - x).alias("c")))))
    return df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), runs.alias("v"))


#: Grams up to which their weights (16 bytes each) are sent to every task.
BROADCAST_ROWS = 1_000_000


def _weighted(grams: DataFrame, idf: DataFrame) -> DataFrame:
    few = idf.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return grams.join(F.broadcast(idf) if few else idf, "g").withColumn("w", F.col("c") * F.col("idf"))


#: Rows of a block (as a power of two) and queries of a group, which meet in one task.
BLOCK_BITS, GROUP = 14, 20_000


def _counted(texts: pa.Array, words: pa.Array | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words (of all texts, if none are given), and (word, text, count) by number, in order of the words."""
    parts = pc.split_pattern(texts, " ")
    flat, row = parts.flatten(), np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    words = pc.unique(flat.filter(pc.not_equal(flat, ""))) if words is None else words
    at = pc.index_in(flat, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
    pair, count = np.unique(at[at >= 0].astype(np.int64) * len(texts) + row[at >= 0], return_counts=True)
    return words, pair // max(1, len(texts)), pair % max(1, len(texts)), count


def _overlaps(asked: pa.Array, held: pa.Array, hot: int) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each asked text and its overlaps with all held ones; words of over `hot` rows are added as dense rows."""
    words, of, query, times = _counted(asked, None)
    _, word, row, count = _counted(held, words)
    begin = np.searchsorted(word, np.arange(len(words) + 1))
    dense = {}
    for t in np.flatnonzero(np.diff(begin) > hot):
        dense[t] = np.zeros(len(held), dtype=np.int64)
        dense[t][row[begin[t] : begin[t + 1]]] = count[begin[t] : begin[t + 1]]
    order = np.argsort(query, kind="stable")
    bound = np.searchsorted(query[order], np.arange(len(asked) + 1))
    for q in range(len(asked)):
        n = np.zeros(len(held), dtype=np.int64)
        for k in order[bound[q] : bound[q + 1]]:
            t = of[k]
            if t in dense:
                n += times[k] * dense[t]
            else:
                n[row[begin[t] : begin[t + 1]]] += times[k] * count[begin[t] : begin[t + 1]]
        yield q, n


def _counts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The overlaps above 0, the largest first, and how many rows have each; few small numbers are counted without sorting."""
    if n.max(initial=0) > 4 * len(n):
        level, c = np.unique(n[n > 0], return_counts=True)
        return level[::-1], c[::-1]
    c = np.bincount(n)
    level = np.flatnonzero(c[1:])[::-1] + 1
    return level, c[level]


def _levels(select: int, hot: int) -> Callable:
    """How many rows of a block have each overlap with a query, the largest overlaps that hold `select` rows."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        for q, n in _overlaps(asked["text"].combine_chunks(), held["text"].combine_chunks(), hot):
            level, c = _counts(n)
            keep = np.cumsum(c) - c < select
            out.append((q, level[keep], c[keep]))
        which = np.repeat([q for q, _, _ in out], [len(n) for _, n, _ in out]).astype(np.int64)
        level, c = (np.concatenate([x[k] for x in out] or [np.zeros(0)]).astype(np.int64) for k in (1, 2))
        return pa.Table.from_arrays([asked["query_id"].combine_chunks().take(pa.array(which)), asked["block"].combine_chunks().take(pa.array(which)), pa.array(level), pa.array(c)], names=["query_id", "block", "n", "c"])

    return run


def _grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of all runs of `size` characters; the number of a gram of up to 3 characters is its own, others are hashed."""
    length = np.array([len(x) for x in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    code = np.zeros(max(0, len(points) - size + 1), dtype=np.uint64)
    for k in range(size):
        code = code * np.uint64(1 << 21 if size <= 3 else 0x9E3779B97F4A7C15) + points[k : k + len(code)]
    row = np.repeat(np.arange(len(texts)), length)[: len(code)]
    whole = np.arange(len(code)) + size <= np.cumsum(length)[row]
    return row[whole], code[whole]


def _nearest(k: int, size: int, hot: int, text: str) -> Callable:
    """The k best by cosine of the rows of a block that a query takes: of each overlap in `takes` the first so many."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held["id"])).combine_chunks()
        texts, keys, norm = held[text].combine_chunks(), held["key"].combine_chunks(), held["norm"].to_numpy()
        asked = asked.combine_chunks()
        takes, vectors = asked["takes"].to_pylist(), asked["v"].to_pylist()
        names = sorted({x["g"] for v in vectors for x in v or ()})
        code = _grams(names, size)[1]
        by = np.argsort(code)
        code, place = code[by], {names[x]: p for p, x in enumerate(by)}
        row, gram = _grams([f" {x} " for x in texts.to_pylist()], size)
        at = np.minimum(np.searchsorted(code, gram), max(0, len(code) - 1))
        known = code[at] == gram if len(code) else np.zeros(len(gram), dtype=bool)
        row, at = row[known], at[known]
        begin = np.searchsorted(row, np.arange(len(texts) + 1))
        out = []
        for q, n in _overlaps(asked["text"].combine_chunks(), texts, hot):
            mine = np.concatenate([np.flatnonzero(n == x["n"])[: x["take"]] for x in takes[q]])
            weight = np.zeros(len(code))
            weight[[place[x["g"]] for x in vectors[q] or ()]] = [x["w"] for x in vectors[q] or ()]
            size_of = begin[mine + 1] - begin[mine]
            entry = np.arange(size_of.sum()) + np.repeat(begin[mine] - np.cumsum(size_of) + size_of, size_of)
            dot = np.bincount(np.repeat(np.arange(len(mine)), size_of), weights=weight[at[entry]], minlength=len(mine))
            score = np.round(np.divide(dot, norm[mine], out=np.zeros(len(mine)), where=norm[mine] > 0), 6)
            best = np.lexsort((mine, -n[mine], -score))[:k]
            out.append((np.full(len(best), q), mine[best], n[mine[best]], score[best]))
        which, found, n, score = (np.concatenate([x[j] for x in out] or [np.zeros(0, dtype=np.int64)]) for j in range(4))
        return pa.Table.from_arrays([asked["query_id"].combine_chunks().take(pa.array(which)), keys.take(pa.array(found)), pa.array(n.astype(np.int64)), pa.array(score.astype(float))], names=["query_id", "id", "n", "cosine"])

    return run


def preselect_and_rerank(queries: DataFrame, rows: DataFrame, query_id: str, query_text: str, id_col: str, text: str, select: int = 3_000, k: int = 5, size: int = 3, hot: int = 4_000) -> DataFrame:
    """(query_id, id, n, cosine): of the `select` rows that share most words with a query, the k nearest by the tf-idf cosine of character grams.

    Words are separated by blanks.  Cosines are rounded to 6 places; ties go to the
    larger overlap, then the smaller id.  Ids name one text each.  Null and empty
    texts share nothing; queries that share no word with any row have no result;
    other columns are ignored.

    Queries of equal texts ask once.  Blocks of rows in the order of their ids meet groups of queries in a grid.  A
    first pass counts the rows of each overlap in every block, which sets how many
    of each a query takes there; a second finds them again and scores them in
    place.  So no pair and no vector of a row is ever shuffled or written, only
    texts, counts and the k best of a block; the work itself grows with the
    words that queries and rows share.
    """
    same = id_col == text
    held = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), *([] if same else [F.col(text).alias("text")]))
    held, name = cut(held.orderBy("key").withColumn("id", F.monotonically_increasing_id())), "key" if same else "text"
    total = held.count()
    grams = gram_counts(held, "id", name, size)
    idf = cut(grams.select(F.explode("v.g").alias("g")).groupBy("g").agg((F.log(F.lit(1.0 + total) / (F.count("*") + 1)) + 1).alias("idf")))
    norms = _weighted(grams.select("id", F.inline("v")), idf).groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("text")).where("query_id is not null and text is not null")
    every_query = cut(asked.dropDuplicates(["query_id"]))
    asked = cut(every_query.select("text").distinct().select(F.monotonically_increasing_id().alias("query_id"), "text"))
    groups = -(-asked.count() // GROUP) or 1
    asked = asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    full = F.concat(F.lit(" "), F.col("text"), F.lit(" "))
    places = F.when(F.length(full) >= size, F.sequence(F.lit(1), F.length(full) - size + 1)).otherwise(F.array().cast("array<int>"))
    own = asked.select("query_id", F.explode(F.transform(places, lambda i: F.substring(full, i, F.lit(size)))).alias("gram")).groupBy("query_id", "gram").agg(F.count("*").alias("c"))
    own = _weighted(own.withColumn("g", F.xxhash64("gram")), idf).groupBy("query_id").agg(F.collect_list(F.struct(F.col("gram").alias("g"), "w", "idf")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    own = own.select("query_id", F.transform("v", lambda x: F.struct(x["g"].alias("g"), (x["w"] / F.col("length") * x["idf"]).alias("w"))).alias("v"))

    held = held.where(F.col(name).isNotNull()).withColumn("block", F.shiftright("id", BLOCK_BITS))
    kind = {f.name: f.dataType.simpleString() for f in held.schema} | {"query_id": asked.schema["query_id"].dataType.simpleString()}
    spread = lambda df: df.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    cells = lambda a, b: a.groupBy("group", "block").cogroup(b.groupBy("group", "block"))
    every = asked.crossJoin(F.broadcast(held.select(F.shiftright("id", BLOCK_BITS).alias("block")).distinct()))  # a number for each of many rows
    levels = cells(every, spread(held.select("block", F.col(name).alias("text")))).applyInArrow(_levels(select, hot), f"query_id {kind['query_id']}, block long, n long, c long")
    before = F.sum("c").over(Window.partitionBy("query_id").orderBy(F.desc("n"), "block").rowsBetween(Window.unboundedPreceding, -1))
    takes = levels.withColumn("take", F.least("c", F.lit(select) - F.coalesce(before, F.lit(0)))).where("take > 0")
    takes = takes.groupBy("query_id", "block").agg(F.collect_list(F.struct("n", "take")).alias("takes"))
    taking = takes.join(asked, "query_id").join(own, "query_id", "left")
    scored = cells(taking, spread(held.join(norms, "id", "left"))).applyInArrow(_nearest(k, size, hot, name), f"query_id {kind['query_id']}, id {kind['key']}, n long, cosine double")
    best = top_k(scored, ["query_id"], [F.desc("cosine"), F.desc("n"), F.asc("id")], k)
    return every_query.join(asked.withColumnRenamed("query_id", "_q"), "text").join(best.withColumnRenamed("query_id", "_q"), "_q").select("query_id", "id", "n", "cosine")
