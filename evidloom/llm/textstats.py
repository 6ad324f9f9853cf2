"""Per-document text statistics, counted on bytes inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as bo
from .runtime import trimmed

_LEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True

COLUMNS = ("n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_stops", "n_distinct_words", "n_line_ends", "longest_word")


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which elements share their key with another of the group, and which with an earlier one."""
    o = bo.order_in_groups(group, key)
    new = bo.first_of_runs(group[o], key[o])
    two = ~new
    two[:-1] |= ~new[1:]
    both, later = np.empty(len(o), bool), np.empty(len(o), bool)
    both[o], later[o] = two, ~new
    return both, later


def statistics(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, doc = bo.words(data, offsets)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LEAD[data], out=lead[1:])
    chars = lead[ends] - lead[starts]
    h = bo.span_hashes(data, starts, ends)
    per = lambda who: np.bincount(who, minlength=n).astype(np.int64)
    # Words inside windows that occur twice or more in the text.
    win, at = bo.windows_hash(h, doc, window)
    twice = at[_again(doc[at], win)[0]] if len(at) else at
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    covered = np.cumsum(cover)[:-1] > 0
    # Lines with a word that equal an earlier line.
    a, b, who = bo.spans_where(data != 10, offsets)
    word = np.zeros(len(data) + 1, np.int64)
    np.cumsum(bo.IS_WORD[data], out=word[1:])
    full = word[b] > word[a]
    a, b, who = a[full], b[full], who[full]
    line = bo.span_hashes(data, a, b, salt=1)
    later = _again(who, line)[1] if len(a) else np.zeros(0, bool)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, chars)
    return {
        "n_bytes": np.diff(offsets),
        "n_chars": lead[offsets[1:]] - lead[offsets[:-1]],
        "n_words": per(doc),
        "word_chars": np.bincount(doc, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_lines": per(who),
        "n_dup_lines": per(who[later]),
        "n_repeat_words": per(doc[covered]),
        "n_upper": _per_text(_UPPER[data], offsets),
        "n_digits": _per_text(_DIGIT[data], offsets),
        "n_stops": _per_text(_STOP[data], offsets),
        "n_distinct_words": per(doc) - (per(doc[_again(doc, h)[1]]) if len(h) else 0),
        "n_line_ends": per(who[_END[data[b - 1]]]) if len(b) else per(who),
        "longest_word": longest,
    }


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, one long column for each of COLUMNS); null texts count as empty."""
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    kept = [f for f in base.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("text")
            others = [i for i in range(len(batch.schema)) if i != where]
            for lo, hi, data, offsets in bo.chunked(batch.column(where)):
                stats = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in others), *(pa.array(stats[c]) for c in COLUMNS)], names=[*(batch.schema.names[i] for i in others), *COLUMNS])

    return base.mapInArrow(trimmed(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} long" for c in COLUMNS]))
