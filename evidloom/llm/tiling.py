"""Benchmark decontamination by greedy string tiling.

Shared-token seeds (n-grams of words) join documents with benchmark items.  Each
such pair is tiled: the longest matches of unmarked words are marked, without
overlap, until none of the minimum length is left; matches of a length are found
by running Karp-Rabin hashes.  An item whose words are covered by tiles to the
threshold is leaked, also where its parts stand in another order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as bo
from .runtime import shared, trimmed

_PAIRS = 1 << 20  # candidate places that are held at once


def _running_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every window of n tokens, by running sums modulo 2**64."""
    m = len(tokens)
    if m < n:
        return np.empty(0, np.uint64)
    p, q = bo.powers(m + 1)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(bo.mix(tokens) * p[:m], out=total[1:])
    return (total[n:] - total[:-n]) * q[: m - n + 1]


def common_runs(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item start, text start, length) of all maximal runs of at least `least` common tokens."""
    mine, theirs = _running_hashes(item, least), _running_hashes(text, least)
    order = np.argsort(theirs, kind="stable")
    lo, hi = (np.searchsorted(theirs[order], mine, side=k) for k in ("left", "right"))
    upto = np.cumsum(hi - lo)
    diag, first, last = [], [], []
    k = 0
    while k < len(mine):  # as many windows of the item at a time as make a bounded number of pairs
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + _PAIRS, side="right")))
        n = hi[k:end] - lo[k:end]
        i = np.repeat(np.arange(k, end), n)
        j = order[np.repeat(lo[k:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        k = end
        for t in range(least):  # equal hashes are only candidates
            same = item[i + t] == text[j + t]
            i, j = i[same], j[same]
        o = np.lexsort((i, j - i))
        d, i = (j - i)[o], i[o]
        new = np.ones(len(i), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)
        at = np.flatnonzero(new)
        diag.append(d[at]), first.append(i[at]), last.append(i[np.append(at[1:], len(i)) - 1] if len(i) else i)
    if not diag:
        return []
    d, a, b = (np.concatenate(x) for x in (diag, first, last))
    o = np.lexsort((a, d))
    d, a, b = d[o], a[o], b[o]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] != b[:-1] + 1)
    at = np.flatnonzero(new)
    d, a, b = d[at], a[at], b[np.append(at[1:], len(b)) - 1] if len(b) else b
    return list(zip(a.tolist(), (a + d).tolist(), (b - a + least).tolist(), strict=True))


def greedy_tiles(item: list[int] | np.ndarray, text: list[int] | np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length): longest first, then by place in the item and the text.

    The longest common run of unmarked tokens is marked, again and again; a run
    of which a part is marked by then comes back as its unmarked parts.
    """
    item, text = (np.asarray(x).astype(np.int64).view(np.uint64) for x in (item, text))
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    heap = [(-n, a, b) for a, b, n in common_runs(item, text, least)]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = free_i[a : a + n] & free_t[b : b + n]
        if free.all():
            tiles.append((a, b, n))
            free_i[a : a + n] = free_t[b : b + n] = False
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if y - x >= least:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return tiles


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """61-bit hashes of the words (letters, digits and other non-space bytes, A-Z lower-cased) and their text."""
    low = bo.LOWER[data]
    starts, ends, doc = bo.words(low, offsets)
    return bo.span_hashes(low, starts, ends) >> np.uint64(3), doc


def _tokens_of(texts: list[str | None]) -> list[np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    h, doc = token_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return np.split(h, bo.offsets_of(doc, len(raw))[1:-1]) if raw else []


def seeds(benchmark: DataFrame, least: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(seed, n, item_id, item, times, words) for every distinct n-gram of an item; n is `least`, or all words of a shorter item.

    `item` tells the texts of a repeated item_id apart.
    """
    base = benchmark.select(F.col(id_col).alias("item_id"), F.xxhash64(text_col).alias("item"), F.col(text_col).alias("text")).where("item_id is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed, size, at, times, words = [], [], [], [], []
            for k, t in enumerate(_tokens_of(batch.column("text").to_pylist())):
                n = min(least, len(t))
                if n:
                    w, m = np.unique(bo.windows_hash(t, np.zeros(len(t), np.int64), n)[0], return_counts=True)
                    seed.append(w.view(np.int64)), times.append(m)
                    size.extend([n] * len(w)), at.extend([k] * len(w)), words.extend([len(t)] * len(w))
            flat, m = (np.concatenate([np.empty(0, np.int64), *x]) for x in (seed, times))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat, pa.int64()), pa.array(size, pa.int32()), batch.column("item_id").take(rows), batch.column("item").take(rows), pa.array(m, pa.int64()), pa.array(words, pa.int64())],
                names=["seed", "n", "item_id", "item", "times", "words"],
            )

    return base.mapInArrow(run, f"seed long, n int, item_id {base.schema['item_id'].dataType.simpleString()}, item long, times long, words long")


def _seeded(sizes: list[int], broadcast):
    """Distinct seeds of each document with the words that they cover; only known ones if those are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = broadcast.value if broadcast is not None else None
        for batch in batches:
            for lo, hi, data, offsets in bo.chunked(batch.column(1)):
                h, doc = token_hashes(data, offsets)
                out_doc, out_n, out_seed, out_at = [], [], [], []
                for n in sizes:
                    w, at = bo.windows_hash(h, doc, n)
                    if known is not None and len(w):
                        hit = known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w if len(known) else np.zeros(len(w), bool)
                        w, at = w[hit], at[hit]
                    out_doc.append(doc[at]), out_n.append(np.full(len(w), n)), out_seed.append(w), out_at.append(at)
                d, n, w, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_doc, out_n, out_seed, out_at))
                if len(d):
                    first = np.searchsorted(doc, d, side="left")
                    ids = batch.column(0).slice(lo, hi - lo).take(pa.array(d))
                    tokens = [h[a : a + k].tobytes() for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(lo, hi - lo).take(pa.array(d)), pa.array(w.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int32)), pa.array((at - first).astype(np.int32)), bo.binary_array(tokens)], names=["doc_id", "row", "seed", "n", "at", "tokens"])

    return run


def _tile(least: int):
    """Seeded words of a pair -> coverage of the item by tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, count, tiles_n, longest = [], [], [], []
            items = _tokens_of(batch.column("text").to_pylist())
            for item, places in zip(items, batch.column("places").to_pylist(), strict=True):
                n = min(least, max(1, len(item)))
                own = {item[k : k + n].tobytes() for k in range(len(item) - n + 1)}
                # The document's words that any seed of the item covers, with a gap where the seeds leave one.
                word: dict[int, int] = {}
                for p in places:
                    if p["tokens"] in own:
                        for k, t in enumerate(np.frombuffer(p["tokens"], np.uint64).tolist()):
                            word[p["at"] + k] = t
                text, last = [], None
                for at in sorted(word):
                    if last is not None and at != last + 1:
                        text.append(-1)
                    text.append(word[at])
                    last = at
                tiles = greedy_tiles(item, text, n)
                covered.append(sum(n for _, _, n in tiles))
                count.append(len(item))
                tiles_n.append(len(tiles))
                longest.append(max((n for _, _, n in tiles), default=0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), *(pa.array(x, pa.int64()) for x in (covered, count, tiles_n, longest))], names=["doc_id", "item_id", "n_covered", "n_item", "n_tiles", "longest"])

    return run


def tiled_pairs(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.0, seed_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_covered, n_item, n_tiles, longest) of all pairs of a text and an item that share a seed and may reach `coverage`.

    Tiles that cover the share `coverage` of an item's words hold a known number
    of its n-grams, one for `least` covered words at least.  So a document need
    only be tiled if it has one of the item's n-grams beside the most common
    ones, fewer than that number: a stock phrase that many documents and items
    hold pairs them with nothing.

    The seed table is sent to the tasks only if its size is checked to be below
    `seed_rows` (8 bytes each); a larger one meets the documents' seeds in a
    shuffled join.  The result is the same.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row")).where("doc_id is not null")
    items = benchmark.select("item_id", F.xxhash64("text").alias("item"), "text").where("item_id is not null").distinct()
    table = shared(seeds(benchmark, least))
    sizes = sorted(r["n"] for r in table.select("n").distinct().collect())  # at most `least` numbers
    few = table.select("seed").distinct().limit(seed_rows + 1).toArrow()["seed"].to_numpy()
    known = spark.sparkContext.broadcast(np.sort(few.astype(np.int64).view(np.uint64))) if len(few) <= seed_rows else None
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(trimmed(_seeded(sizes, known)), f"doc_id {kind}, row long, seed long, n int, at int, tokens binary")
    if known is None:
        found = found.join(table.select("seed", "n").distinct(), ["seed", "n"], "left_semi")
    found = shared(found)
    often = found.groupBy("seed", "n").agg(F.count("*").alias("often"))
    commonest = Window.partitionBy("item_id", "item").orderBy(F.desc("often"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    telling = table.join(often, ["seed", "n"]).withColumn("upto", F.sum("times").over(commonest))
    telling = telling.where(F.col("upto") >= F.greatest(F.lit(1.0), F.ceil(F.col("words") * coverage / F.col("n") - 1e-9)))
    pair = found.select("doc_id", "row", "seed", "n").join(telling.select("seed", "n", "item_id", "item"), ["seed", "n"]).select("doc_id", "row", "item_id", "item").distinct()
    places = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "tokens")).alias("places"))
    kind_i = items.schema["item_id"].dataType.simpleString()
    both = pair.join(places, ["doc_id", "row"]).join(items, ["item_id", "item"]).select("doc_id", "item_id", "text", "places")
    return both.mapInArrow(trimmed(_tile(least)), f"doc_id {kind}, item_id {kind_i}, n_covered long, n_item long, n_tiles long, longest long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_leaked, item_id, coverage, contaminated) of every row; ids of any type that can be ordered.

    A document is contaminated if tiles of at least `least` words (all words, in
    a shorter item) cover the share `coverage` of an item's words; item_id is
    the one covered most (then the smallest id) of those that the document was
    tiled with, null without one.  Null and empty texts and items share
    nothing; the texts of a repeated doc_id are tiled each, and each of its rows
    tells what was found in any of them; a null doc_id
    is kept as clean.  Very long texts are tiled whole; extra columns are
    ignored; empty tables leak nothing.
    """
    pairs = tiled_pairs(docs, benchmark, least, coverage, id_col=id_col, text_col=text_col).withColumn("coverage", F.col("n_covered") / F.col("n_item"))
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))  # of an id's texts, or of an item's, the one covered most
    best = pairs.groupBy("doc_id").agg(F.count_if(F.col("coverage") >= coverage).alias("n_leaked"), F.min_by("item_id", F.struct(-F.col("coverage"), F.col("item_id"))).alias("item_id"), F.max("coverage").alias("coverage"))
    out = docs.select(F.col(id_col).alias("doc_id")).join(best, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_leaked", F.lit(0)).cast("long").alias("n_leaked"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), (F.coalesce("n_leaked", F.lit(0)) > 0).alias("contaminated"))
