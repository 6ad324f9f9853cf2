"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find.

SuperMinHash draws for every shingle one random permutation of the signature
slots and visits it rank by rank: the value written at rank j lies in
[j, j + 1), so the ranks of one shingle are correlated and a text stops as soon
as no slot can improve.  Signatures are banded; texts that share a band are
candidates.

Links are exact on the candidates.  A bucket is not expanded into pairs: every
member is compared with one centre, the member that shares most bands with
others.  If x misses the threshold with the centre R, then J(x, y) <= J(x, R)
for every y that shares none of x's deviations from R (R - x and x - R): the
intersection of x and y is then inside x & R and their union covers x | R.
So only pairs that share a deviation are left, found by an equi-join on it, and
their similarity follows from counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as bo
from .components import components
from .runtime import fits, salted_join, semi_by_id, shared, trimmed

_GOLD = 0x9E3779B97F4A7C15
#: Bytes of text whose shingles are at work at a time.
_CHUNK = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by text and hash.

    A text with fewer words than the size has its whole word sequence as one
    shingle; a text without words has none.
    """
    data = bo.LOWER[data]
    starts, ends, doc = bo.words(data, offsets)
    h = bo.span_hashes(data, starts, ends)
    window, at = bo.windows_hash(h, doc, size)
    group = doc[at]
    count = np.bincount(doc, minlength=len(offsets) - 1)
    for n in range(1, size):
        if (few := np.flatnonzero(count == n)).size:
            own = np.isin(doc, few)
            short, k = bo.windows_hash(h[own], doc[own], n)
            window, group = np.concatenate([window, short]), np.concatenate([group, doc[own][k]])
    o = bo.order_in_groups(group, window)
    window, group = window[o], group[o]
    keep = bo.first_of_runs(group, window)
    return window[keep], group[keep]


def superminhash(h: np.ndarray, group: np.ndarray, n_groups: int, slots: int) -> np.ndarray:
    """Signatures (n_groups x slots); inf in the rows of empty groups."""
    sig = np.full(n_groups * slots, np.inf)
    wide, perm = np.uint64, None
    rows, local = h, group
    for j in range(slots):
        x = bo.mix(rows + wide((j + 1) * _GOLD & bo._MASK))
        value = (x >> wide(11)).astype(np.float64) * 2.0**-53 + j
        k = j + (bo.mix(x ^ wide(_GOLD)) % wide(slots - j)).astype(np.int64)
        at = np.arange(len(rows))
        if perm is None:
            slot = k
        else:
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
            perm[at, j] = slot
        np.minimum.at(sig, local * slots + slot, value)
        open_ = sig.reshape(n_groups, slots).max(axis=1) >= j + 1
        live = open_[local]
        if not live.any():
            break
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint16), (int(live.sum()), 1))
            first = k[live]
            own = np.arange(len(perm))
            perm[own, first] = perm[:, 0]
            perm[own, 0] = first
            rows, local = rows[live], local[live]
        elif live.sum() < 0.9 * len(live):
            perm, rows, local = perm[live], rows[live], local[live]
    return sig.reshape(n_groups, slots)


def _features(size: int, bands: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bo.chunked(batch.column(1), _CHUNK):
                n = hi - lo
                h, group = shingle_sets(data, offsets, size)
                sig = superminhash(h, group, n, bands * depth).view(np.uint64).reshape(n, bands, depth)
                key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD), (n, 1))
                for k in range(depth):
                    key = bo.mix(key * np.uint64(0x9FB21C651E98DF25) + sig[:, :, k])
                offs = bo.offsets_of(group, n)
                count = np.diff(offs)
                sets = [hashlib.blake2b(h[a:b], digest_size=16).digest() if b > a else None for a, b in zip(offs, offs[1:], strict=False)]
                some = np.where(count > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(count), pa.array(sets, pa.binary()), bo.list_array(key[count > 0].view(np.int64).ravel(), np.concatenate([[0], np.cumsum(some)]), pa.int64())],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bo.chunked(batch.column(1), _CHUNK):
                h, group = shingle_sets(data, offsets, size)
                offs = bo.offsets_of(group, hi - lo)
                blobs = [h[a:b].tobytes() for a, b in zip(offs, offs[1:], strict=False)]
                keys = [hashlib.blake2b(b, digest_size=16).digest() for b in blobs]
                yield pa.RecordBatch.from_arrays([bo.binary_array(keys), bo.binary_array(blobs)], names=["set_key", "shingles"])

    return run


def _compare(percent: int):
    """One row per (member, centre): the sizes, the verdict and the member's deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lost, extra = [], [], []
            for x, r in zip(batch.column("x_set"), batch.column("r_set"), strict=True):
                x, r = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(r.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(r, x), len(r) - 1)
                hit = r[at] == x
                gone = np.ones(len(r), bool)
                gone[at[hit]] = False
                both = int(hit.sum())
                sizes.append((len(x), len(r), both, 100 * both >= percent * (len(x) + len(r) - both)))
                lost.append(r[gone].view(np.int64))
                extra.append(x[~hit].view(np.int64))
            cols = list(zip(*sizes, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("r"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_()), pa.array(lost, pa.list_(pa.int64())), pa.array(extra, pa.list_(pa.int64()))],
                names=["x", "r", "n_x", "n_r", "n_both", "linked", "lost", "extra"],
            )

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 24, depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; ids are numbers or strings.

    A text's set is its distinct `size`-word shingles of lower-cased (A-Z) words.
    Texts are linked at 100 * intersection >= percent * union; a pair of that
    similarity shares a band with probability over 0.99999 (24 bands of 4).
    Null, empty and wordless texts have no set and link with nothing.  Rows that
    repeat a doc_id count as one document: whatever is near one of its texts belongs
    to it; a row without words stands alone.  A row with a null doc_id is kept and
    linked with nothing (component_id null).  Very long texts count whole; other
    columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    feats = shared(docs.mapInArrow(trimmed(_features(size, bands, depth)), f"{docs.schema['doc_id'].name} {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_key binary, bands array<long>"))
    some = feats.where("set_key is not null and doc_id is not null")
    # Equal sets are one class, named by their hash; only classes are compared.  An id may hold several.
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = some.groupBy("set_key").agg(F.min_by("bands", "doc_id").alias("bands"))
    band = reps.select("set_key", F.explode("bands").alias("key"))
    wide = shared(band.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    total = wide.agg(F.sum("n")).first()[0] or 0
    member = shared(salted_join(band, wide.withColumn("_n", F.col("n")), "key", "_n", ["set_key"], total=total))
    central = member.groupBy("set_key").agg(F.sum("n").alias("score"))
    centre = member.join(central, "set_key").groupBy("key").agg(F.min_by("set_key", F.struct(-F.col("score"), F.col("set_key"))).alias("r"), F.count("*").alias("_n"))
    star = shared(salted_join(member, centre, "key", "_n", ["set_key"], total=total).where("set_key <> r").select(F.col("set_key").alias("x"), "r").distinct())
    wanted = star.select(F.col("x").alias("set_key")).union(star.select(F.col("r").alias("set_key"))).distinct()
    ids = classes.join(wanted, "set_key", "left_semi").select(F.col("rep").alias("doc_id"))
    sets = semi_by_id(docs, ids).mapInArrow(trimmed(_sets(size)), "set_key binary, shingles binary").groupBy("set_key").agg(F.min("shingles").alias("shingles"))
    sets = shared(sets)
    centres = sets.join(star.groupBy(F.col("r").alias("set_key")).agg(F.count("*").alias("_n")), "set_key").select(F.col("set_key").alias("r"), F.col("shingles").alias("r_set"), "_n")
    pairs = star.join(sets.select(F.col("set_key").alias("x"), F.col("shingles").alias("x_set")), "x")
    pairs = salted_join(pairs, centres, "r", "_n", ["x"])
    seen = shared(pairs.select("x", "r", "x_set", "r_set").mapInArrow(trimmed(_compare(percent)), "x binary, r binary, n_x long, n_r long, n_both long, linked boolean, lost array<long>, extra array<long>"))
    links = seen.where("linked").select(F.col("x").alias("a"), F.col("r").alias("b"))
    # The classes of one id belong together.
    several = shared(some.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("_high")).where("a <> _high").select("doc_id", "a"))
    if not several.isEmpty():
        links = links.unionByName(some.join(F.broadcast(several) if fits(several) else several, "doc_id").select("a", F.col("set_key").alias("b")).where("a <> b").distinct())
    found = shared(components(links))
    # Only links between the components found so far are left to find; they join these components.
    across = shared(_beside_centres(seen, found, percent))
    linked = classes.join(found.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    if not across.isEmpty():
        joined = components(across).select(F.col("node").alias("component"), F.col("component").alias("top"))
        joined = F.broadcast(joined) if fits(joined) else joined
        linked = linked.join(joined, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top")
    linked = shared(linked)
    # A component is named by its smallest document; one of a single class by its own.
    low = linked.groupBy("component").agg(F.min("rep").alias("low"), F.count("*").alias("_n")).where("_n > 1")
    linked = salted_join(linked, low, "component", "_n", ["set_key"], how="left").select("set_key", F.coalesce("low", "rep").alias("component_id"))
    out = feats.select("doc_id", "n_shingles", "set_key").join(linked, "set_key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _beside_centres(seen: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that a link joins between members of a centre, of which one at least misses the threshold with it.

    Members a and b of centre r have n_r - lost_a - lost_b + common elements in
    common, where common counts shared deviations; so they need a known number
    of those, and share one among the rarest of either side (prefix filter).
    Members of one component need no further link, so deviations that only they
    share count as shared by nobody: a large group of near copies makes no pairs.
    """
    odd = seen.groupBy("r").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("misses")).where("n > 1 and misses > 0").select("r")
    lost = F.transform("lost", lambda v: F.struct(F.lit(0).alias("side"), v.alias("v")))
    extra = F.transform("extra", lambda v: F.struct(F.lit(1).alias("side"), v.alias("v")))
    seen = seen.join(odd, "r").join(found.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("of", F.coalesce("component", "x"))
    seen = shared(seen.select("r", "x", "of", "n_x", "n_r", "linked", F.size("lost").alias("n_lost"), F.size("extra").alias("n_extra"), F.concat(lost, extra).alias("dev")))
    each = seen.select("r", "x", "of", F.explode("dev").alias("d")).select("r", "x", "of", "d.side", "d.v")
    often = each.groupBy("r", "side", "v").agg(F.count("*").alias("c"), F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("r", "side", "v", "c")
    rare = each.join(often, ["r", "side", "v"]).groupBy("r", "x").agg(F.sort_array(F.collect_list(F.struct("c", "side", "v"))).alias("d"))
    # Deviations that no other component shares come first in the order; they only shift the places.
    rare = rare.join(seen.select("r", "x", "of", "n_x", "n_r", "linked", "n_lost", F.size("dev").alias("n_dev"), "n_extra"), ["r", "x"])
    rare = rare.select("r", "x", "of", "n_x", "n_r", "linked", "n_lost", "n_extra", "n_dev", F.posexplode("d").alias("i", "e"), (F.col("n_dev") - F.size("d")).alias("alone"))
    rare = rare.select("*", (F.col("i") + F.col("alone")).alias("place"), "e.side", "e.v")
    # A miss needs this many shared deviations, even if the other side has no further ones ...
    need = F.ceil(F.expr(f"{percent} * (n_r + n_extra) / 100.0D - 1e-9")) - F.col("n_r") + F.col("n_lost")
    miss = rare.where("not linked").where(F.col("place") <= F.col("n_dev") - need)
    miss = miss.select("r", "side", "v", F.col("x").alias("a"), F.col("of").alias("of_a"), F.col("n_x").alias("n_a"), F.col("n_lost").alias("lost_a"), F.col("n_dev").alias("dev_a"), F.col("place").alias("place_a"))
    # ... and the other side must share more than this part of its own with any miss.
    part = F.floor(F.expr(f"({percent} * n_extra + 100 * n_lost) / ({100 + percent}.0D) + 1e-9"))
    other = rare.where(F.col("place") <= F.col("n_dev") - part - 1)
    other = other.select("r", "side", "v", F.col("x").alias("b"), F.col("of").alias("of_b"), F.col("n_x").alias("n_b"), F.col("n_lost").alias("lost_b"), F.col("n_dev").alias("dev_b"), F.col("place").alias("place_b"), "n_r", "linked")
    least = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent} - n_r + lost_a + lost_b")
    both = miss.join(other, ["r", "side", "v"])
    # A pair of two misses is met once, from its smaller end.
    both = both.where("of_a <> of_b and (linked or a < b)").where((F.col("place_a") <= F.col("dev_a") - least) & (F.col("place_b") <= F.col("dev_b") - least))
    pair = both.select("r", "a", "b", "of_a", "of_b", "n_a", "n_b", "n_r", "lost_a", "lost_b").distinct()
    pair = pair.join(seen.select("r", F.col("x").alias("a"), F.col("dev").alias("da")), ["r", "a"]).join(seen.select("r", F.col("x").alias("b"), F.col("dev").alias("db")), ["r", "b"])
    return pair.where(F.size(F.array_intersect("da", "db")) >= least).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
