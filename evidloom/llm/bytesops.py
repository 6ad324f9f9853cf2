"""Vectorised views of Arrow text columns: words, spans and 64-bit span hashes.

All helpers work on one bounded chunk of whole texts at a time, so a task
holds a few MB of work arrays however long its partition is (a text longer
than the chunk bound makes a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BYTE_CODE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b & _MASK, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunked(column: pa.Array, max_bytes: int = CHUNK_BYTES, max_rows: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts."""
    raw, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + max_rows, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans_where(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true inside each text: starts, ends, text number."""
    n = len(mask)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    cut = offsets[1:-1]
    before[cut[cut < n]] = False
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as maximal runs of bytes other than space and 0x09-0x0D."""
    return spans_where(IS_WORD[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each span."""
    n = len(data)
    p, q = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * p[:n], out=total[1:])
    h = (total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h + np.uint64(salt * 0x632BE59BD9B4E019 & _MASK))


def windows_hash(h: np.ndarray, group: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive elements of a group, and where each window starts."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(h) - n + 1
    at = np.flatnonzero(group[:m] == group[n - 1 :])
    acc = np.full(len(at), np.uint64((salt + n) * 0x2545F4914F6CDD1D & _MASK))
    for k in range(n):
        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + h[at + k])
    return acc, at


def order_in_groups(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by group, then key; groups are small non-negative numbers."""
    first = np.argsort(key, kind="stable")
    return first[np.argsort(group[first].astype(np.uint16), kind="stable")]


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """True where sorted keys differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def offsets_of(group: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of n groups in rows that are sorted by group."""
    return np.searchsorted(group, np.arange(n + 1), side="left")


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
