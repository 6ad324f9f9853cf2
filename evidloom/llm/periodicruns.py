"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of words with smallest period q, of max(min_length, 2q) words
or more, that no neighbouring word extends.  It overlaps its own shift by q in
at least k = ceil(min_length / 2) words, so each of its words lies in a k-gram
that the text holds twice.  Words outside all such k-grams cannot join a run: they
cut a text into segments, mostly none, and a run lies in one segment whole.

A segment is divided in halves again and again.  A run that crosses a block's
middle has a period of at most half the block, and the middle word agrees with
the word one period before or after it; how far that agreement reaches either way
gives the run.  All blocks of a level and all periods are tried at once, by
arrays.  Agreement is measured by names of all stretches of 1, 2, 4, ... words
(equal names: equal words), exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as bo
from .runtime import small_batches


def repeated_kgram_words(h: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their text holds twice or more; h are hashes of words, text their texts' numbers."""
    gram, at = bo.windows_hash(h, text, k)
    cover = np.zeros(len(h) + 1, np.int64)
    if len(at):
        order = bo.order_in_groups(text[at], gram)
        new = bo.first_of_runs(text[at][order], gram[order])
        twice = ~new
        twice[:-1] |= ~new[1:]
        np.add.at(cover, at[order[twice]], 1)
        np.add.at(cover, at[order[twice]] + k, -1)
    return np.cumsum(cover)[:-1] > 0


class Names:
    """Names of all stretches of 2**l words that lie in one segment; equal names stand for equal stretches."""

    def __init__(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """words: small numbers of words; begin, end: bounds of the segment of each word."""
        self.begin, self.end = begin, end
        self.levels = [words.astype(np.int64)]
        longest = max(2, int((end - begin).max(initial=0)))
        while 2 << (len(self.levels) - 1) <= longest:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            at = np.arange(len(low))
            whole = np.flatnonzero(at + 2 * half <= end)
            pairs = low[whole] * (int(low.max()) + 2) + low[whole + half]
            names = np.full(len(low), -1, np.int64)
            names[whole] = np.unique(pairs, return_inverse=True)[1]
            self.levels.append(names)

    def pairs_equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two words from a on equal those from b on (a < b, of one segment but that a may lie before it)."""
        return (a >= self.begin[b]) & (self.levels[1][a] == self.levels[1][b])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on (a < b, of one segment)."""
        out = np.zeros(len(a), np.int64)
        if len(a):
            end = self.end[a]
            for level in range(len(self.levels) - 1, -1, -1):
                may = np.flatnonzero(b + out + (1 << level) <= end)
                same = may[self.levels[level][a[may] + out[may]] == self.levels[level][b[may] + out[may]]]
                out[same] += 1 << level
        return out

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to a (it included) equal those up to b (a < b, of one segment; a may be the place before its first word)."""
        out = np.zeros(len(a), np.int64)
        if len(a):
            begin = self.begin[b]
            for level in range(len(self.levels) - 1, -1, -1):
                step = 1 << level
                may = np.flatnonzero(a - out - step + 1 >= begin)
                same = may[self.levels[level][a[may] - out[may] - step + 1] == self.levels[level][b[may] - out[may] - step + 1]]
                out[same] += step
        return out


def main_lorentz(names: Names, segments: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of the segments (rows of begin, end)."""
    found, blocks = [np.empty((0, 3), np.int64)], segments[segments[:, 1] - segments[:, 0] >= min_length]
    while len(blocks):
        lo, hi = blocks[:, 0], blocks[:, 1]
        middle = (lo + hi) // 2
        half = (hi - lo + 1) // 2
        which = np.repeat(np.arange(len(blocks)), half)
        q = np.arange(len(which)) - np.repeat(np.cumsum(half) - half, half) + 1
        m = middle[which]
        for a, b in ((m, m + q), (m - q, m)):  # the period's next copy lies behind the middle, or its last one before
            good = (a >= lo[which]) & (b < hi[which])
            a, b, p = a[good], b[good], q[good]
            # Agreement of max(p, min_length - p) words in all has two words on one side at least.
            good = names.pairs_equal(a, b) | names.pairs_equal(a - 2, b - 2)
            a, b, p = a[good], b[good], p[good]
            ahead = names.ahead(a, b)
            back = names.back(a - 1, b - 1)
            enough = (back + ahead >= p) & (back + ahead + p >= min_length)
            found.append(np.stack([(a - back)[enough], (b + ahead)[enough], p[enough]], axis=1))
        blocks = np.concatenate([np.stack([lo, middle], axis=1), np.stack([middle, hi], axis=1)])
        blocks = blocks[blocks[:, 1] - blocks[:, 0] >= min_length]
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[bo.first_of_runs(rows[:, 0], rows[:, 1])] if len(rows) else rows  # of one stretch's periods the smallest


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of words, by numbers of words over the whole chunk."""
    keep = repeated_kgram_words(bo.span_hashes(data, starts, ends), text, -(-min_length // 2))
    at = np.flatnonzero(keep)
    if not len(at):
        return np.empty((0, 3), np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])
    first = np.flatnonzero(new)
    segments = np.stack([first, np.append(first[1:], len(at))], axis=1)
    of = np.cumsum(new) - 1
    raw = data.tobytes()
    spelled: dict[bytes, int] = {}
    words = np.fromiter((spelled.setdefault(raw[a:b], len(spelled)) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)), np.int64, len(at))
    rows = main_lorentz(Names(words, segments[of, 0], segments[of, 1]), segments, min_length)
    return np.stack([at[rows[:, 0]], at[rows[:, 1] - 1] + 1, rows[:, 2]], axis=1)


def periodic_runs(docs: DataFrame, min_length: int = 12, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_words, runs, collapsed) of every row.

    `runs` lists (start, length, period), all in words numbered from 0, by start,
    then period.  `collapsed` has the words, joined by one space, without those
    that a run contains after its first period.  Words are maximal runs of bytes
    other than space and 0x09 to 0x0D.  Null and empty texts have no words, no runs
    and an empty `collapsed`.  Repeated rows and ids are answered each; texts of any
    length are taken whole, and work with the words of a task's chunk or of its
    longest text; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    kept = [f for f in base.schema if f.name != "text"]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("text")
            others = [i for i in range(len(batch.schema)) if i != where]
            for lo, hi, data, offsets in bo.chunked(batch.column(where)):
                starts, ends, text = bo.words(data, offsets)
                first = bo.offsets_of(text, hi - lo)
                rows = runs_of(data, starts, ends, text, min_length)
                rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
                own = text[rows[:, 0]]
                spans = pa.StructArray.from_arrays([pa.array(x) for x in (rows[:, 0] - first[own], rows[:, 1] - rows[:, 0], rows[:, 2])], fields=list(run_type))
                runs = pa.ListArray.from_arrays(pa.array(bo.offsets_of(own, hi - lo).astype(np.int32)), spans)
                gone = np.zeros(len(starts) + 1, np.int64)
                np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
                np.add.at(gone, rows[:, 1], -1)
                stay = np.cumsum(gone)[:-1] == 0
                collapsed, raw = [], data.tobytes()
                dropped = set(text[~stay].tolist())
                for i in range(hi - lo):
                    spelled = raw[offsets[i] : offsets[i + 1]].split()  # the same words, as ASCII blanks are what they lie between
                    if i in dropped:
                        spelled = [spelled[j] for j in np.flatnonzero(stay[first[i] : first[i + 1]])]
                    collapsed.append(b" ".join(spelled))
                cells = [*(batch.column(i).slice(lo, hi - lo) for i in others), pa.array(np.diff(first)), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cells, names=[*(batch.schema.names[i] for i in others), "n_words", "runs", "collapsed"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_words long", "runs array<struct<start: long, length: long, period: long>>", "collapsed string"])
    return base.mapInArrow(run, schema)


def longest_run(runs: Column) -> Column:
    """The run of greatest length, ties by smallest start, then period; null where there is none."""
    worse = lambda a, b: (b["length"] > a["length"]) | ((b["length"] == a["length"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(worse(a, b), b).otherwise(a))


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs where one text in ten, by a hash of its id, ends in copies of a stretch of its words: word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = (h % 10 == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.withColumns({"_g": F.floor(h / 10).cast("long"), "_words": F.when(chosen, words)}).withColumn("_n", F.size("_words").cast("long"))
    rows = rows.withColumn("_a", F.expr("_g % nullif(_n, 0)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    cycle = F.expr("slice(_words, cast(_a + 1 as int), cast(_p as int))")
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.expr("cast((_n - _a) div _p + 1 as int)"))), F.lit(1), F.expr("cast(_n - _a as int)"))
    planted = F.array_join(F.concat(F.expr("slice(_words, 1, cast(_a as int))"), tail), " ")
    return rows.withColumn(text_col, F.when(F.col("_words").isNotNull(), planted).otherwise(F.col(text_col))).drop("_g", "_words", "_n", "_a", "_p")
