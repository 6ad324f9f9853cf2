"""Removal of byte passages that an earlier document has too, by suffix arrays.

Every 50-byte window selects one anchor: the 16-byte gram of smallest hash in it.
The choice depends on the window's bytes alone, so equal windows of two documents
select equal grams.  Neighbouring windows of one anchor form a snippet.

1. A chunk of documents settles the snippets that it holds twice: later documents
   lose theirs whole, and the earliest asks for all.  What it asks goes to hash
   buckets of the anchor: the anchor's and the snippet's hash and its place.
2. A bucket settles equal snippets of different chunks alike.  If an anchor has
   different snippets, windows of them may still be equal: the earliest document
   of each is told to send its bytes.
3. A bucket sorts the suffixes of these snippets by the two-stage method:
   suffixes smaller than their successors are sorted directly, all others are
   induced by one scan over the character buckets.  Runs of adjacent suffixes
   with a common prefix of 50 bytes are equal windows, and those of documents
   after the run's first are removed.

So a hot passage reaches its bucket once per chunk, and the bytes of a snippet
once.  At its two ends every carrier has a snippet of its own, though: an anchor
with many different snippets in a chunk, or in a bucket, is hot.  Windows of hot
anchors leave the anchor's bucket: a task settles those that it holds twice,
and the earliest of each goes to a bucket of its own hash, where the earliest of
all is found.  Copies of a whole text are settled before, by a group over the text's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as bo
from .runtime import partitions, salted_join, shared, trimmed

_HASH_SALT = np.uint64(0xA0761D6478BD642F)
_HASH_ODD = np.uint64(0xE7037ED1A0B428DB)
#: Bytes of text that settle their snippets together, and whose anchors are found at a time.
_FLUSH, _CHUNK = 12 << 20, 1 << 19


def _load64(data: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte words at every position; data must have 7 bytes to spare."""
    n = len(data) - 7
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def two_stage_suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of the text, right to `depth` bytes at least (0 sorts before any end)."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1  # the last suffix is larger than the empty one
    nearest = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    small = step[nearest] > 0  # smaller than its successor
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    word = _load64(padded)

    # Stage one: sort the small suffixes directly, eight bytes a pass, ties only.
    s = np.flatnonzero(small)
    s = s[np.argsort(word[s], kind="stable")]
    lo = 0
    tie = np.zeros(len(s), bool)
    if len(s) > 1:
        same = word[s[1:]] == word[s[:-1]]
        tie[1:] |= same
        tie[:-1] |= same
        head = np.cumsum(np.concatenate([[True], ~same]))
        while tie.any() and lo + 8 < depth:
            lo += 8
            at = np.flatnonzero(tie)
            own = s[at]
            key = word[np.minimum(own + lo, n)]
            o = np.lexsort((key, head[at]))
            s[at] = own[o]
            key, group = key[o], head[at][o]
            same = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
            still = np.zeros(len(at), bool)
            still[1:] |= same
            still[:-1] |= same
            head[at] = np.cumsum(np.concatenate([[True], ~same]))
            tie[at] = still

    # Stage two: induce the larger suffixes from left to right.
    count = np.bincount(text, minlength=256)
    begin = np.concatenate([[0], np.cumsum(count)])
    n_small = np.bincount(text[s], minlength=256) if len(s) else np.zeros(256, np.int64)
    sa = np.full(n, -1, np.int64)
    first = np.cumsum(np.concatenate([[0], n_small]))
    fill = begin[:256].copy()
    for c in range(256):
        sa[begin[c + 1] - n_small[c] : begin[c + 1]] = s[first[c] : first[c + 1]]
    sa[fill[text[-1]]] = n - 1
    fill[text[-1]] += 1
    for c in range(256):
        if begin[c] == begin[c + 1]:
            continue
        seen = begin[c]
        while seen < fill[c]:  # larger suffixes that start with c twice come from this bucket itself
            wave = sa[seen : fill[c]] - 1
            seen = fill[c]
            wave = wave[wave >= 0]
            wave = wave[(text[wave] == c) & ~small[wave]]
            sa[fill[c] : fill[c] + len(wave)] = wave
            fill[c] += len(wave)
        before = sa[begin[c] : begin[c + 1]] - 1
        before = before[before >= 0]
        before = before[(text[before] > c) & ~small[before]]
        if len(before):
            char = text[before]
            o = np.argsort(char, kind="stable")
            before, char = before[o], char[o]
            run = np.flatnonzero(bo.first_of_runs(char))
            size = np.diff(np.append(run, len(char)))
            start = fill[char[run]]
            sa[np.repeat(start - run, size) + np.arange(len(char))] = before
            fill[char[run]] += size
    return sa


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix length, up to the limit, of each suffix in the order with the one before."""
    padded = np.concatenate([text, np.zeros(limit + 16, np.uint8)])
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(0, limit, 8):
        width = min(8, limit - k)
        a, b = order[live] + k, order[live - 1] + k
        left = np.ones(len(live), bool)
        for j in range(width):
            left &= padded[np.minimum(a + j, len(padded) - 1)] == padded[np.minimum(b + j, len(padded) - 1)]
            out[live] += left
        live = live[left]
        if not len(live):
            break
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and end window start, and text number, of runs of windows with one anchor."""
    none = np.empty(0, np.int64)
    n = len(data)
    if n < length:
        return none.astype(np.uint64), none, none, none
    words = _load64(data)
    gram = bo.mix(words ^ _HASH_SALT)
    size = 8
    if length >= 32:  # two words, which unrelated texts hardly share
        gram = bo.mix(gram[:-8] + words[8:] * _HASH_ODD)
        size = 16
    width = length - size + 1  # grams in a window
    best, span = gram, 1
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    m = n - length + 1
    best = np.minimum(best[:m], best[width - span : width - span + m])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    inside = np.arange(m) + length <= offsets[doc + 1]
    # A window belongs to the same run as the one before if it has the same smallest gram value.
    # Equal values mean equal grams, so runs of one value may join several places of one gram.
    at = np.flatnonzero(inside)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    value, who = best[at], doc[at]
    head = np.flatnonzero(bo.first_of_runs(value, who))
    end = np.append(at[head[1:] - 1], at[-1]) + 1
    return value[head], at[head], end, who[head]


def _planes(x: np.ndarray, width: int = 4) -> bytes:
    """The lowest bytes of numbers by byte planes, which compress far better in a shuffle."""
    return np.ascontiguousarray(x).astype(np.int64).view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _numbers(raw: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.int64).ravel()


def _codes(ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each distinct (id, tag), and the id and tag of each number."""
    o = np.lexsort((tags, ids))
    new = bo.first_of_runs(ids[o], tags[o]) if len(o) else np.zeros(0, bool)
    code = np.empty(len(o), np.int64)
    code[o] = np.cumsum(new) - 1
    return code, ids[o][new], tags[o][new]


def _spans_by_row(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each row as maximal runs, ordered by row."""
    o = np.lexsort((lo, row))
    row, lo, hi = row[o], lo[o], hi[o]
    first = bo.first_of_runs(row)
    # Running maximum of the ends inside each row: rows are lifted above each other.
    lift = np.cumsum(first) * (int(hi.max(initial=0)) + 1)
    top = np.maximum.accumulate(hi + lift) - lift
    new = first.copy()
    new[1:] |= lo[1:] > top[:-1]
    at = np.flatnonzero(new)
    return row[at], lo[at], top[np.append(at[1:], len(row)) - 1] if len(row) else top


#: Bytes of a snippet's hash that are sent beside its anchor's four.
_DIGEST = 6
_ASK = "bucket int, kind int, ids binary, tags binary, owners binary, anchors binary, digests binary, starts binary, sizes binary"


#: Kinds of rows: what is asked or compared, what is settled, and what belongs to hot anchors.
_OPEN, _TOLD, _HOT = 0, 1, 2
#: Different snippets with which an anchor is hot, in a chunk and in a bucket, and the bucket number that stands for it.
HOT_IN_CHUNK, HOT_IN_BUCKET = 64, 4096
_BY_WINDOW = (1 << 32) - 1


def _ask_row(bucket: int, kind: int, ids: np.ndarray, tags: np.ndarray, owners: np.ndarray, anchor: np.ndarray, digest: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    parts = [_planes(ids, 8), _planes(tags), _planes(owners), anchor.tobytes(), _planes(digest.view(np.int64), _DIGEST), _planes(starts), _planes(sizes)]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *(bo.binary_array([x]) for x in parts)], names=[c.split()[0] for c in _ASK.split(", ")])


def _ask(length: int, buckets: int, hot_in_chunk: int):
    """Chunks of documents -> what their earliest holders of each snippet ask, and what later ones lose."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0] + [len(x[0]) for x in held])
        who = np.concatenate([x[3] + np.int32(b) for x, b in zip(held, base, strict=False)])
        ids, tags, text, h, digest, start, size = (np.concatenate([x[k] for x in held]) for k in (0, 1, 2, 4, 5, 6, 7))
        held.clear()
        # Of copies in this chunk the smallest document asks for all.
        o = np.lexsort((ids, text))
        asks = np.zeros(len(ids), bool)
        asks[o[bo.first_of_runs(text[o])]] = True
        # Documents by id, so that a stable sort by snippet puts the earliest first.
        place = np.empty(len(ids), np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        at = np.flatnonzero(asks[who])
        at = at[np.argsort(place[who[at]], kind="stable")]
        if not len(at):
            return
        at = at[np.argsort(bo.mix(h[at] ^ _HASH_SALT) + digest[at], kind="stable")]
        new = bo.first_of_runs(h[at], digest[at])
        low = ids[who[at]][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = ids[who[at]] > low
        if later.any():
            t = at[later]
            doc, lo, hi = _spans_by_row(who[t], start[t], start[t] + size[t])
            local, owner = np.unique(doc, return_inverse=True)
            yield _ask_row(int(tags[local[0]] % buckets), _TOLD, ids[local], tags[local], owner, np.empty(0, np.uint32), np.empty(0, np.uint64), lo, hi - lo)
        value, n = np.unique(h[at[new]], return_counts=True)
        value = value[n > hot_in_chunk]
        at = np.sort(at[~later])
        to = lambda x: ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        if len(value):  # these documents answer themselves, and the anchor's bucket learns that it is hot
            hot = np.isin(h[at], value)
            own, at = at[hot], at[~hot]
            local, owner = np.unique(who[own], return_inverse=True)
            yield _ask_row(int(tags[local[0]] % buckets), _HOT, ids[local], tags[local], owner, np.empty(0, np.uint32), np.empty(0, np.uint64), start[own], size[own])
            for b in np.unique(to(value)).tolist():
                mine = value[to(value) == b]
                none = np.zeros(len(mine), np.int64)
                yield _ask_row(b, _OPEN, none[:1], none[:1], none, mine.astype(np.uint32), none.view(np.uint64), none, none)
        bucket = to(h[at])
        o = np.argsort(bucket, kind="stable")
        at, cut = at[o], np.searchsorted(bucket[o], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = at[cut[b] : cut[b + 1]]
            local, owner = np.unique(who[own], return_inverse=True)
            yield _ask_row(b, _OPEN, ids[local], tags[local], owner, h[own].astype(np.uint32), digest[own], start[own], size[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lo, hi, data, offsets in bo.chunked(batch.column(2), _CHUNK):
                h, first, end, who = anchors(data, offsets, length)
                text = np.frombuffer(b"".join(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest() for a, b in zip(offsets, offsets[1:], strict=False)), np.uint64)
                digest = bo.span_hashes(data, first, end + length - 1)
                ids, tags = (np.asarray(batch.column(k).slice(lo, hi - lo), dtype=np.int64) for k in range(2))
                held.append((ids, tags, text, who.astype(np.int32), h, digest, (first - offsets[who]).astype(np.int32), (end - first + length - 1).astype(np.int32)))
                size += len(data)
                if size >= _FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


#: Parts of a bucket that are compared one after another, so that a task's arrays stay small; a power of two.
_PARTS = 8
_PACKED = "place int, ids binary, tags binary, spans binary, sends binary, lo binary, hi binary, starts binary, sizes binary, buckets binary"
_ANSWER = "doc_id long, tag long, lo binary, hi binary, starts binary, sizes binary, buckets binary"


def _answers(batches: Iterator[pa.RecordBatch], places: int, hot_in_bucket: int) -> Iterator[pa.RecordBatch]:
    """All asks of some buckets -> what each row loses, and the places whose bytes are to be sent.

    The answers for many documents share a row for each place that the documents' hashes name.
    """
    told, asked, send = [], [], [[np.empty(0, np.int64)] * 5]
    for batch in batches:
        for x in batch.to_pylist():
            ids, tags = _numbers(x["ids"], 8), _numbers(x["tags"])
            owner, start, size = (_numbers(x[k]) for k in ("owners", "starts", "sizes"))
            if x["kind"] == _TOLD:
                told.append((ids[owner], tags[owner], start, start + size))
            elif x["kind"] == _HOT:
                send.append([ids[owner], tags[owner], start, size, np.full(len(start), _BY_WINDOW)])
            else:
                key = np.uint64(x["bucket"]) << np.uint64(32) | np.frombuffer(x["anchors"], np.uint32).astype(np.uint64)
                asked.append((key, _numbers(x["digests"], _DIGEST), ids[owner], tags[owner], start, size))
    key = np.empty(0, np.uint64)
    if asked:
        key, digest, ids, tags, start, size = (np.concatenate([x[k] for x in asked]) for k in range(6))
        asked.clear()
        hot = np.unique(key[size == 0])  # what chunks have named
        o = np.lexsort((ids, digest, key))
        o = o[size[o] > 0]
        key, digest, ids, tags, start, size = (x[o] for x in (key, digest, ids, tags, start, size))
    if len(key):
        new = bo.first_of_runs(key, digest)
        head = np.flatnonzero(new)
        low = ids[head][np.cumsum(new) - 1]
        later = ids > low
        told.append((ids[later], tags[later], start[later], (start + size)[later]))
        # Anchors of which two documents are the earliest of some snippet.
        first = np.flatnonzero(bo.first_of_runs(key[head]))
        many = np.minimum.reduceat(ids[head], first) != np.maximum.reduceat(ids[head], first)
        n = np.diff(np.append(first, len(head)))
        by_window = np.isin(key[head[first]], hot) | (n > hot_in_bucket)
        every = lambda x: np.repeat(np.repeat(x, n), np.diff(np.append(head, len(key))))
        at = np.flatnonzero(every(many | by_window) & ~later)
        send.append([ids[at], tags[at], start[at], size[at], np.where(every(by_window)[at], _BY_WINDOW, (key[at] >> np.uint64(32 - _PARTS.bit_length() + 1)).astype(np.int64))])
    send = [np.concatenate([x[k] for x in send]) for k in range(5)]
    if not told and not len(send[0]):
        return
    lost = [np.concatenate([np.empty(0, np.int64), *(x[k] for x in told)]) for k in range(4)]
    code, ids, tags = _codes(np.concatenate([lost[0], send[0]]), np.concatenate([lost[1], send[1]]))
    row, lo, hi = _spans_by_row(code[: len(lost[0])], lost[2], lost[3])
    sender = code[len(lost[0]) :]
    place = (bo.mix(ids.view(np.uint64)) % np.uint64(places)).astype(np.int64)
    # Documents, their spans and their sends, each ordered by place and then by document.
    docs, spans, sends = np.argsort(place, kind="stable"), np.argsort(place[row], kind="stable"), np.lexsort((sender, place[sender]))
    cuts = [np.searchsorted(x, np.arange(places + 1)) for x in (place[docs], place[row][spans], place[sender][sends])]
    n_spans, n_sends = np.bincount(row, minlength=len(ids)), np.bincount(sender, minlength=len(ids))
    for p in np.flatnonzero(np.diff(cuts[0])).tolist():
        own, part, to = (x[c[p] : c[p + 1]] for x, c in zip((docs, spans, sends), cuts, strict=True))
        packed = [_planes(ids[own], 8), *map(_planes, (tags[own], n_spans[own], n_sends[own], lo[part], hi[part], *(x[to] for x in send[2:])))]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(bo.binary_array([x]) for x in packed)], names=[c.split()[0] for c in _PACKED.split(", ")])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All answers for the documents of some places -> one row for each document."""
    docs, spans, sends = [], [], []
    base = 0
    for batch in batches:
        for x in batch.to_pylist():
            ids, tags, n_spans, n_sends = _numbers(x["ids"], 8), _numbers(x["tags"]), _numbers(x["spans"]), _numbers(x["sends"])
            own = np.arange(base, base + len(ids))
            docs.append((ids, tags))
            spans.append((np.repeat(own, n_spans), _numbers(x["lo"]), _numbers(x["hi"])))
            sends.append((np.repeat(own, n_sends), *(_numbers(x[c]) for c in ("starts", "sizes", "buckets"))))
            base += len(ids)
    if not docs:
        return
    code, ids, tags = _codes(*(np.concatenate(x) for x in zip(*docs, strict=True)))
    row, lo, hi = (np.concatenate(x) for x in zip(*spans, strict=True))
    row, lo, hi = _spans_by_row(code[row], lo, hi)
    sender, start, size, bucket = (np.concatenate(x) for x in zip(*sends, strict=True))
    o = np.argsort(code[sender], kind="stable")
    a, b = np.searchsorted(row, np.arange(len(ids) + 1)), np.searchsorted(code[sender][o], np.arange(len(ids) + 1))
    cols = ((a, lo), (a, hi), (b, start[o]), (b, size[o]), (b, bucket[o]))
    for k in range(0, len(ids), 2000):
        ks = range(k, min(k + 2000, len(ids)))
        packed = [bo.binary_array([_planes(x[cut[i] : cut[i + 1]]) for i in ks]) for cut, x in cols]
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 2000]), pa.array(tags[k : k + 2000]), *packed], names=[c.split()[0] for c in _ANSWER.split(", ")])


_CUT = "bucket int, kind int, ids binary, tags binary, starts binary, sizes binary, parts binary, bytes binary"


def _earliest(ids: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by digest and id, and where in it the id is not the digest's smallest."""
    o = np.lexsort((ids, digest))
    new = bo.first_of_runs(digest[o])
    return o, ids[o] > ids[o][np.flatnonzero(new)][np.cumsum(new) - 1]


def _window_spans(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows -> maximal runs of each row."""
    code, ids, tags = _codes(ids, tags)
    row, lo, hi = _spans_by_row(code, start, start + length)
    return ids[row], tags[row], lo, hi


def _cut(length: int, buckets: int):
    """Rows with their answers -> snippets to compare, by bucket; what is settled goes along."""

    def windows(hot: list, told: list) -> Iterator[pa.RecordBatch]:
        ids, tags, start, size = (np.concatenate([x[k] for x in hot]) for k in range(4))
        raw = np.frombuffer(b"".join(p for x in hot for p in x[4]), np.uint8)
        n = size - length + 1
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(size) - size, n) + inner
        digest = bo.span_hashes(raw, at, at + length)
        ids, tags, start = np.repeat(ids, n), np.repeat(tags, n), np.repeat(start, n) + inner
        o, later = _earliest(ids, digest)
        if later.any():
            told.append(_window_spans(ids[o[later]], tags[o[later]], start[o[later]], length))
        at = np.sort(o[~later])
        bucket = (digest[at] % np.uint64(buckets)).astype(np.int64)
        o = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[o], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = at[o[cut[b] : cut[b + 1]]]
            yield _row(b, _HOT, ids[own], tags[own], start[own], np.empty(0, np.int64), b"", digest[own].tobytes())

    def flush(told: list, send: list, hot: list) -> Iterator[pa.RecordBatch]:
        if hot:
            yield from windows(hot, told)
        if told:
            ids, tags, lo, hi = (np.concatenate([x[k] for x in told]) for k in range(4))
            yield _row(int(tags[0] % buckets), _TOLD, ids, tags, lo, hi - lo, b"", b"")
        if send:
            ids, tags, start, size, part = (np.concatenate([x[k] for x in send]) for k in range(5))
            raw = [p for x in send for p in x[5]]
            bucket = part // _PARTS
            o = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[o], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = o[cut[b] : cut[b + 1]]
                yield _row(b, _OPEN, ids[own], tags[own], start[own], size[own], (part[own] % _PARTS).astype(np.uint8).tobytes(), b"".join(raw[k] for k in own.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, send, hot, held = [], [], [], 0
        for batch in batches:
            text = batch.column("text")
            ids, tags = (np.asarray(batch.column(k), dtype=np.int64) for k in ("doc_id", "tag"))
            answers = [batch.column(c) for c in ("lo", "hi", "starts", "sizes", "buckets")]
            for k in range(len(batch)):
                lo, hi, start, size, bucket = (_numbers(x[k].as_py()) for x in answers)
                if len(lo):
                    own = np.ones(len(lo), np.int64)
                    told.append((ids[k] * own, tags[k] * own, lo, hi))
                if len(start):
                    raw = text[k].as_buffer().to_pybytes()
                    by_window = bucket == _BY_WINDOW
                    for own in (~by_window, by_window):
                        if own.any():
                            a, n, all_ = start[own], size[own], np.ones(int(own.sum()), np.int64)
                            part = [raw[x : x + y] for x, y in zip(a.tolist(), n.tolist(), strict=True)]
                            if own is by_window:
                                hot.append((ids[k] * all_, tags[k] * all_, a, n, part))
                                held += 60 * int(n.sum())
                            else:
                                send.append((ids[k] * all_, tags[k] * all_, a, n, bucket[own], part))
                held += 16 * len(lo) + 40 * len(start) + int(size.sum())
                if held >= _FLUSH // 2:
                    yield from flush(told, send, hot)
                    told, send, hot, held = [], [], [], 0
        yield from flush(told, send, hot)

    return run


def _row(bucket: int, kind: int, ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, sizes: np.ndarray, part: bytes, raw: bytes) -> pa.RecordBatch:
    parts = [_planes(ids, 8), _planes(tags), _planes(starts), _planes(sizes), part, raw]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *(bo.binary_array([x]) for x in parts)], names=[c.split()[0] for c in _CUT.split(", ")])


def match_snippets(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(snippet number, from, to) of windows that a document of a smaller id has too, among these snippets."""
    offs = np.concatenate([[0], np.cumsum(sizes)])
    digest = bo.span_hashes(raw, offs[:-1], offs[1:]) ^ sizes.astype(np.uint64)
    o = np.lexsort((starts, ids, digest))
    head = np.flatnonzero(bo.first_of_runs(digest[o]))
    rep = o[head]  # the first document's first occurrence of each distinct snippet
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(o))))
    whole = ids[o] > ids[rep][group]
    out = [(o[whole], starts[o][whole], (starts + sizes)[o][whole])]
    # The suffix array of the distinct snippets, each closed by a zero byte.
    room = sizes[rep] + 1
    place = np.concatenate([[0], np.cumsum(room)])
    text = np.zeros(place[-1], np.uint8)
    inner = np.arange(place[-1]) - np.repeat(place[:-1], room)
    real = inner < np.repeat(sizes[rep], room)
    text[real] = raw[(np.repeat(offs[rep], room) + inner)[real]]
    snippet = np.repeat(np.arange(len(rep)), room)
    valid = inner + length <= np.repeat(sizes[rep], room)
    sa = two_stage_suffix_array(text, length)
    sa = sa[valid[sa]]
    if len(sa):
        lcp = common_prefixes(text, sa, length)
        run = np.flatnonzero(lcp < length)
        low = np.repeat(np.minimum.reduceat(ids[rep][snippet[sa]], run), np.diff(np.append(run, len(sa))))
        lost = np.zeros(len(text), bool)
        lost[sa[ids[rep][snippet[sa]] > low]] = True
        if lost.any():
            a, b, who = bo.spans_where(lost, place)
            # The same holds for all occurrences of the snippet in its first document.
            same = np.flatnonzero(~whole)
            by = group[same]
            order = np.argsort(by, kind="stable")
            same, by = same[order], by[order]
            n = np.bincount(by, minlength=len(rep))
            begin = np.concatenate([[0], np.cumsum(n)])
            reps = n[who]
            at = same[np.repeat(begin[who], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
            a, b = np.repeat(a - place[who], reps), np.repeat(b - place[who], reps)
            out.append((o[at], starts[o][at] + a, starts[o][at] + b + length - 1))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _match(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, told, hot = {}, [], []
        for batch in batches:
            for x in batch.to_pylist():
                ids, tags, start, size = _numbers(x["ids"], 8), _numbers(x["tags"]), _numbers(x["starts"]), _numbers(x["sizes"])
                if x["kind"] == _TOLD:
                    told.append((ids, tags, start, start + size))
                elif x["kind"] == _HOT:
                    hot.append((ids, tags, start, np.frombuffer(x["bytes"], np.uint64)))
                else:
                    part, raw = np.frombuffer(x["parts"], np.uint8), np.frombuffer(x["bytes"], np.uint8)
                    for p in np.unique(part).tolist():
                        own = part == p
                        asks.setdefault((x["bucket"], p), []).append((ids[own], tags[own], start[own], size[own], raw[np.repeat(own, size)]))
        for b in list(asks):
            ids, tags, start, size, raw = (np.concatenate(x) for x in zip(*asks.pop(b), strict=True))
            who, lo, hi = match_snippets(ids, start, size, raw, length)
            told.append((ids[who], tags[who], lo, hi))
        if hot:
            ids, tags, start, digest = (np.concatenate([x[k] for x in hot]) for k in range(4))
            o, later = _earliest(ids, digest)
            told.append(_window_spans(ids[o[later]], tags[o[later]], start[o[later]], length))
        if not told:
            return
        ids, tags, lo, hi = (np.concatenate([x[k] for x in told]) for k in range(4))
        code, ids, tags = _codes(ids, tags)
        row, lo, hi = _spans_by_row(code, lo, hi)
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        for k in range(0, len(ids), 2000):
            ks = range(k, min(k + 2000, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 2000]), pa.array(tags[k : k + 2000]), *(bo.binary_array([x[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in ks]) for x in (lo, hi))], names=["doc_id", "tag", "lo", "hi"])

    return run


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs."""
    o = np.argsort(lo, kind="stable")
    lo, hi = lo[o], np.maximum.accumulate(hi[o])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


_SPANS = "from_bytes array<int>, to_bytes array<int>"


def _widened(raw: bytes, lo: list[int], hi: list[int]) -> tuple[list[int], list[int]]:
    """Runs that end between characters."""
    for k in range(len(lo)):
        while lo[k] > 0 and raw[lo[k]] & 0xC0 == 0x80:
            lo[k] -= 1
        while hi[k] < len(raw) and raw[hi[k]] & 0xC0 == 0x80:
            hi[k] += 1
    a, b = _merge(np.array(lo, np.int64), np.array(hi, np.int64))
    return a.tolist(), b.tolist()


def _apply(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Texts and removed pieces -> maximal removed runs and the bytes that are left."""
    for batch in batches:
        text, copy, los, his = (batch.column(k) for k in ("text", "copy", "lo", "hi"))
        a, b, left = [], [], []
        for k in range(len(batch)):
            raw = text[k].as_py() or b""
            if copy[k].as_py():
                lo, hi = [0], [len(raw)]
            else:
                lo = np.frombuffer(b"".join(los[k].as_py() or ()), np.int32)
                hi = np.frombuffer(b"".join(his[k].as_py() or ()), np.int32)
                lo, hi = (x.tolist() for x in _merge(lo, hi)) if len(lo) else ([], [])
            if whole and lo:
                lo, hi = _widened(raw, lo, hi)
            keep, at = [], 0
            for x, y in zip(lo, hi, strict=True):
                keep.append(raw[at:x])
                at = y
            a.append(lo)
            b.append(hi)
            left.append(b"".join([*keep, raw[at:]]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(len(batch.schema) - 4)), text, pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())), bo.binary_array(left)],
            names=[*batch.schema.names[:-4], "text", "from_bytes", "to_bytes", "left_bytes"],
        )


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), whole_characters: bool = False, hot_in_chunk: int = HOT_IN_CHUNK, hot_in_bucket: int = HOT_IN_BUCKET) -> DataFrame:
    """(doc_id, *keep, text, from_bytes, to_bytes, left_bytes): what each document loses.

    A byte is removed if a window of `length` bytes that covers it also starts in
    a document of a smaller id; windows never cross documents, and overlaps count.
    Null and empty texts lose nothing and have empty bytes; texts shorter than
    `length` lose nothing.  Rows that repeat a doc_id are one document as to each
    other, whatever their texts.  Rows with a null doc_id come last of all and are left as they are.
    With `whole_characters`, a UTF-8 character of which a byte goes, goes whole.
    Very long texts are judged whole; columns outside `keep` are ignored; an
    empty table gives an empty result.  Ids are integers; others are an error.
    `hot_in_chunk` and `hot_in_bucket` say from how many different snippets on an
    anchor is split by windows; the result is the same.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{id_col} must be an integer column; number other ids before")
    spark = docs.sparkSession
    buckets = partitions(spark)
    if length < 8:
        raise ValueError("passages of less than 8 bytes have no anchors")
    held = [F.struct(*keep).alias("_keep")] if keep else []  # so that no kept name clashes with one below
    # A plain column where it is one already: an alias of its own would keep Spark from reusing the exchange below.
    ident = F.col("doc_id") if id_col == "doc_id" and docs.schema["doc_id"].dataType.simpleString() == "bigint" else F.col(id_col).cast("long").alias("doc_id")
    base = docs.select(ident, *held, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    # Rows of one id and text share their fate; rows of one id with other texts are told apart by the tag.
    named = base.where("doc_id is not null").withColumn("tag", F.crc32("text"))
    key = ["doc_id", "tag"]
    long_enough = named.where(F.octet_length("text") >= length)
    digest = F.unhex(F.sha2("text", 256))
    first = shared(long_enough.groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = salted_join(long_enough.select(*key, digest.alias("digest")), first, "digest", "n", ["doc_id", "tag"])
    copies = shared(copies.where("doc_id > first").select(*key).distinct())
    asked = long_enough.select(*key, "text").mapInArrow(trimmed(_ask(length, buckets, hot_in_chunk)), _ASK).repartitionById(buckets, F.col("bucket"))
    answered = asked.mapInArrow(trimmed(lambda batches: _answers(batches, buckets, hot_in_bucket)), _PACKED)
    known = answered.repartitionById(buckets, F.col("place")).mapInArrow(trimmed(_unpacked), _ANSWER)
    # One exchange of the texts serves both joins, as both want the same of its columns.
    ask = named.join(known.hint("shuffle_hash"), key).join(copies.hint("shuffle_hash"), key, "left_anti")
    cut = ask.mapInArrow(trimmed(_cut(length, buckets)), _CUT).repartitionById(buckets, F.col("bucket"))
    lost = cut.mapInArrow(trimmed(_match(length)), "doc_id long, tag long, lo binary, hi binary")
    lost = lost.groupBy(*key).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    out = named.join(lost.hint("shuffle_hash"), key, "left").join(copies.withColumn("copy", F.lit(True)).hint("shuffle_hash"), key, "left").drop("tag")
    out = out.unionByName(base.where("doc_id is null"), allowMissingColumns=True)
    kept = ["_keep"] if keep else []
    schema = ", ".join(["doc_id long", *[f"_keep {base.schema['_keep'].dataType.simpleString()}" for _ in kept]])
    out = out.select("doc_id", *kept, "text", "copy", "lo", "hi").mapInArrow(trimmed(lambda batches: _apply(batches, whole_characters)), f"{schema}, text binary, {_SPANS}, left_bytes binary")
    return out.select("doc_id", *[F.col("_keep")[c].alias(c) for c in keep], "text", "from_bytes", "to_bytes", "left_bytes")
