"""SentencePiece encoding and decoding over a piece table, as a relational lattice.

Texts are cut into units at places that no piece can span; a corpus has far
fewer distinct units than words.  The lattice of the distinct units is a table:
every substring that may be a piece, by its head and length, is exploded and
joined with the piece table, the edges are grouped by unit, and a higher-order
aggregate folds Viterbi over them, scores from left to right and the path back;
a unit of over LONGEST_UNIT bytes takes the same Viterbi in one linear pass
instead.  Documents then take the pieces of their units: frequent units from a
broadcast table of bounded size, all others by a join.

Scores add up (the unigram rule), whatever model the table stems from.  Ties
take the longer last piece.  Characters without a piece become byte pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import bytesops as bo
from .runtime import partitions, shared, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units of more bytes are segmented by one linear pass instead of the lattice, so that no lattice is unbounded.
LONGEST_UNIT = 512
#: Bytes of the broadcast table of frequent units, by the bound of index_bytes.
BROADCAST_BYTES = 96 << 20
#: Bytes of units, by index_bytes, that one task makes lattices of at a time: their edges are a few hundred times as much.
LATTICE_BYTES = 1 << 19
#: First characters of a substring by which the lengths of longer pieces are looked up.
HEAD = 4
_FLUSH, _CHUNK = 4 << 20, 1 << 19
_UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class PieceTable:
    pieces: list[str]  # of ordinary pieces, spaces as SPACE
    ids: list[int]
    scores: list[float]
    byte_ids: list[int]  # of each byte
    size: int

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @property
    def unknown_score(self) -> float:
        return min(self.scores) - _UNKNOWN_PENALTY


def load_pieces(path: str = MODEL) -> PieceTable:
    """Piece table of a SentencePiece model file with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rest = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    return PieceTable([sp.id_to_piece(i) for i in rest], rest, [sp.get_score(i) for i in rest], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], sp.get_piece_size())


def normalized(text: Column) -> Column:
    """Literal U+2581 reads as a space; a text that is not empty gets a space in front."""
    return F.when(F.length(text) > 0, F.concat(F.lit(" "), F.replace(text, F.lit(SPACE), F.lit(" ")))).otherwise(F.lit(""))


def _joins(table: PieceTable) -> np.ndarray:
    """Byte pairs (last of a character, first of the next) that some piece holds."""
    out = np.zeros(1 << 16, bool)
    for p in table.pieces:
        chars = [c.encode() for c in p.replace(SPACE, " ")]
        for a, b in zip(chars, chars[1:], strict=False):
            out[a[-1] << 8 | b[0]] = True
    return out


def cut_units(data: np.ndarray, offsets: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the units; they cover all bytes."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    lead = (data & 0xC0) != 0x80
    cut = np.zeros(n, bool)
    pair = data[:-1].astype(np.uint16) << 8 | data[1:]
    cut[1:] = ~joins[pair] & lead[1:]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def distinct_units(texts: DataFrame, table: PieceTable) -> DataFrame:
    """(unit, n): distinct units of the column `text` and how often they occur."""
    joins = _joins(table)

    def flush(held: list) -> pa.RecordBatch:
        h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        parts = [p for x in held for p in x[2]]
        h, first, at = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=n, minlength=len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([parts[i] for i in first.tolist()], pa.string()), pa.array(total)], names=["unit", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in bo.chunked(batch.column("text"), _CHUNK):
                starts, ends, _ = cut_units(data, offsets, joins)
                h, first, n = np.unique(bo.span_hashes(data, starts, ends), return_index=True, return_counts=True)
                raw = data.tobytes()
                held.append((h, n, [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
                size += len(data)
                if size >= _FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return texts.select("text").mapInArrow(trimmed(run), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def best_ids(unit: str, known: dict[str, tuple[int, float] | None], table: PieceTable) -> list[int]:
    """Ids of the best segmentation; `known` has every prefix of a piece, with id and score where it is a piece.

    A position keeps a score and the last piece's start and id only, so time and memory are linear in the unit.
    """
    n, unknown = len(unit), table.unknown_score
    best, start, last = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        for j in range(i + 1, n + 1):
            hit = known.get(unit[i:j], -1)
            if hit is None or hit == -1:
                # A character that is no piece becomes bytes.
                if j == i + 1 and here + unknown > best[j]:
                    best[j], start[j], last[j] = here + unknown, i, -1
                if hit is None:
                    continue
                break
            if here + hit[1] > best[j]:
                best[j], start[j], last[j] = here + hit[1], i, hit[0]
    out, j = [], n
    while j:
        i = start[j]
        out.extend([last[j]] if last[j] >= 0 else [table.byte_ids[b] for b in reversed(unit[i:j].encode())])
        j = i
    return out[::-1]


def _long_units(table: PieceTable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            if known is None:
                pieces = [p.replace(SPACE, " ") for p in table.pieces]
                known = {p[:k]: None for p in pieces for k in range(1, len(p))}
                known |= {p: (i, float(s)) for p, i, s in zip(pieces, table.ids, table.scores, strict=True)}
            for unit in batch.column("unit").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.string()), pa.array([best_ids(unit, known, table)], pa.list_(pa.int32()))], names=["unit", "ids"])

    return run


def head_lengths(table: PieceTable) -> dict[str, list[int]]:
    """Lengths of the pieces of HEAD and more characters, by their first HEAD."""
    out: dict[str, set[int]] = {}
    for p in table.pieces:
        if len(p) >= HEAD:
            out.setdefault(p[:HEAD].replace(SPACE, " "), set()).add(len(p))
    return {head: sorted(sizes) for head, sizes in out.items()}


def encode_units(units: DataFrame, table: PieceTable, any_long: bool = True, size: int = 0) -> DataFrame:
    """(unit, ids): the best segmentation of each distinct unit; without `any_long` no unit has over LONGEST_UNIT bytes.

    `size` is what index_bytes gives for all units: the more there is, the more tasks.
    """
    spark = units.sparkSession
    edges = spark.createDataFrame([(p.replace(SPACE, " "), i, float(s)) for p, i, s in zip(table.pieces, table.ids, table.scores, strict=True)], "piece string, id int, score double")
    # Every unit stays whole: those that are too long for a lattice in one row go through one pass in Python.
    if any_long:
        wide = F.octet_length("unit") > LONGEST_UNIT
        long = units.where(wide).select("unit").mapInArrow(_long_units(table), "unit string, ids array<int>")
        return encode_units(units.where(~wide), table, False, size).unionByName(long)
    # Dealt by unit once, so that the edges of a unit are made, joined and grouped where it is.
    units = units.select("unit").repartition(max(partitions(spark), -(-size // LATTICE_BYTES)), "unit")
    # Substrings of each place: all of fewer than HEAD characters, longer ones only of lengths that pieces with the same head have.
    heads = spark.createDataFrame(list(head_lengths(table).items()), "head string, lengths array<int>")
    at = units.select("unit", F.explode(F.sequence(F.lit(0), F.greatest(F.length("unit") - 1, F.lit(0)))).alias("start"))
    at = at.select("unit", "start", F.substring("unit", F.col("start") + 1, F.lit(table.longest)).alias("part"))
    at = at.join(F.broadcast(heads), F.substring("part", 1, HEAD) == F.col("head"), "left")
    few = F.sequence(F.lit(1), F.least(F.lit(HEAD - 1), F.length("part")))
    sub = at.select("unit", "start", "part", F.explode(F.concat(few, F.coalesce("lengths", F.array().cast("array<int>")))).alias("size")).where(F.col("size") <= F.length("part"))
    sub = sub.select("unit", "start", (F.col("start") + F.col("size")).alias("end"), F.substring("part", F.lit(1), F.col("size")).alias("piece"))
    # The piece table is a parameter of fixed size; it is broadcast as it is.
    met = sub.join(F.broadcast(edges), "piece", "left").where(F.col("id").isNotNull() | (F.col("end") == F.col("start") + 1))
    raw = F.hex(F.encode("piece", "UTF-8"))
    byte_ids = F.array(*[F.lit(i) for i in table.byte_ids])
    fallback = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda j: F.element_at(byte_ids, F.conv(F.substr(raw, j, F.lit(2)), 16, 10).cast("int") + 1))
    score, ids = F.coalesce("score", F.lit(table.unknown_score)).alias("score"), F.when(F.col("id").isNotNull(), F.array("id")).otherwise(fallback).alias("ids")
    met = met.select("unit", F.struct("end", (F.col("end") - F.col("start")).alias("size"), "start", score, ids).alias("e"))
    grouped = met.groupBy("unit").agg(F.sort_array(F.collect_list("e")).alias("lattice"))
    # Forwards the best score of each place, numbers only; then backwards along the first edge, so the longest, that gives it.
    fold = F.expr("""aggregate(lattice, array(0.0D), (acc, e) ->
        CASE WHEN size(acc) = e.end THEN array_append(acc, acc[e.start] + e.score)
             WHEN acc[e.start] + e.score > acc[e.end] THEN array_append(slice(acc, 1, e.end), acc[e.start] + e.score)
             ELSE acc END,
        best -> aggregate(reverse(lattice), struct(size(best) - 1 as at, cast(array() as array<int>) as ids), (path, e) ->
             CASE WHEN e.end = path.at AND best[e.start] + e.score = best[e.end] THEN struct(e.start as at, concat(e.ids, path.ids) as ids)
                  ELSE path END).ids)""")
    return grouped.select("unit", fold.alias("ids"))


Index = tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted hashes of units, offsets of their piece ids, and those ids


def _index(h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Index:
    """Plain arrays, which every Python worker can load; in slices, so that no work array is much larger than the index."""
    o = np.argsort(h, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out = np.empty_like(ids)
    ends = np.concatenate([[0], np.cumsum(sizes[o], dtype=np.int64)])
    for k in range(0, len(o), 100_000):
        part = o[k : k + 100_000]
        out[ends[k] : ends[k + len(part)]] = _gather(ids, offsets, part)[0]
    return h[o], ends.astype(np.uint32) if len(ids) < 1 << 32 else ends, out


def _find(index: Index, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the index, or -1."""
    known = index[0]
    if not len(known):
        return np.full(len(h), -1, np.int64)
    few, back = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(known, few), len(known) - 1)
    return np.where(known[at] == few, at, -1)[back]


def index_bytes(unit: Column) -> Column:
    """Bound of a unit's bytes in an index: its hash, offset and at most one id of two bytes for each byte."""
    return F.lit(12) + 2 * F.octet_length(unit)


def _hash_units(units: pa.Array) -> np.ndarray:
    out = [np.empty(0, np.uint64)]
    for _, _, data, offsets in bo.chunked(units, _CHUNK):
        out.append(bo.span_hashes(data, offsets[:-1], offsets[1:]))
    return np.concatenate(out)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded units -> their hashes, ids and id counts as bytes, one row a batch."""
    for batch in batches:
        lists = batch.column("ids")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        flat = np.asarray(lists.values, dtype=np.int64)[offsets[0] : offsets[-1]]
        wide = np.uint16 if not len(flat) or flat.max() < 1 << 16 else np.uint32
        h = _hash_units(batch.column("unit"))
        yield pa.RecordBatch.from_arrays([*(bo.binary_array([x.tobytes()]) for x in (h, flat.astype(wide), np.diff(offsets).astype(np.uint32))), pa.array([np.dtype(wide).itemsize], pa.int32())], names=["h", "ids", "sizes", "width"])


def _collected(encoded: DataFrame) -> Index:
    """The index of encoded units, whose bytes the caller has bounded."""
    rows = encoded.select("unit", "ids").mapInArrow(_packed, "h binary, ids binary, sizes binary, width int").toArrow()
    width = rows["width"].to_numpy()
    h, sizes = (np.concatenate([np.empty(0, t), *(np.frombuffer(x.as_buffer(), t) for x in rows[c])]) for c, t in (("h", np.uint64), ("sizes", np.uint32)))
    ids = np.concatenate([np.empty(0, np.uint16), *(np.frombuffer(x.as_buffer(), np.uint16 if w == 2 else np.uint32) for x, w in zip(rows["ids"], width, strict=True))])
    del rows  # before the index is laid out
    pa.default_memory_pool().release_unused()
    return _index(h, ids, sizes)


def _gather(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values of the lists `at`, one after another, and the length of each."""
    first = offsets[at].astype(np.int64)
    size = offsets[at + 1] - first
    end = np.cumsum(size)
    return values[np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - size), size)], size


@dataclass
class Decoder:
    """Bytes of each piece id."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, table: PieceTable) -> Decoder:
        raw = [b""] * table.size
        for p, i in zip(table.pieces, table.ids, strict=True):
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(table.byte_ids):
            raw[i] = bytes([b])
        return cls(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.data, self.offsets, ids.astype(np.int64))[0]


def encode_documents(docs: DataFrame, table: PieceTable, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, ids, decoded): piece ids of every row's whole text, and the text decoded from them.

    Null and empty texts have no pieces and decode to an empty text.  U+2581 in
    a text decodes to a space; all else comes back exactly.  Very long texts and
    long runs without a place to cut stay whole.  Repeated rows and null ids are
    encoded like any other; an empty table gives an empty result.  Columns
    outside `keep` are ignored; a kept one may have any name but doc_id, ids and
    decoded, which are an error.
    """
    if clash := sorted({"doc_id", "ids", "decoded"} & set(keep)):
        raise ValueError(f"kept columns would clash with those of the result: {clash}")
    spark = docs.sparkSession
    rest = [F.struct(*keep).alias("rest")] if keep else []
    base = docs.select(F.col(id_col).alias("doc_id"), *rest, normalized(F.coalesce(text_col, F.lit(""))).alias("text"))
    units = shared(distinct_units(base, table))
    # Frequent units as far as the bound goes, by powers of two of their count.
    size = index_bytes(F.col("unit"))
    levels = units.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.sum(size).alias("bytes"), F.max(F.octet_length("unit")).alias("longest")).orderBy(F.desc("level")).collect()  # 64 rows at most
    any_long = any(r["longest"] > LONGEST_UNIT for r in levels)
    least, room, total = None, broadcast_bytes, sum(r["bytes"] for r in levels)
    for r in levels:
        if r["bytes"] > room:
            break
        room -= r["bytes"]
        least = r["level"]
    hot = broadcast_bytes - room
    rare = bool(levels) and (least is None or least > levels[-1]["level"])
    often = F.floor(F.log2("n")) >= F.lit(least if least is not None else 1 << 20)
    index = spark.sparkContext.broadcast(_collected(encode_units(units.where(often), table, any_long, hot)))
    if rare:
        row = base.withColumn("row", F.xxhash64("doc_id", "text"))  # rows of one id and text have the same units
        wanted = row.select("row", "text").mapInArrow(_missing(table, index), "row long, unit string").distinct()
        extra = wanted.join(encode_units(units.where(~often), table, any_long, total - hot), "unit").groupBy("row").agg(F.collect_list(F.struct("unit", "ids")).alias("extra"))
        base = row.join(extra, "row", "left").drop("row")
    else:
        base = base.withColumn("extra", F.lit(None).cast("array<struct<unit:string,ids:array<int>>>"))
    out = _encode(base, table, index)
    return out.select("doc_id", *[F.col("rest")[c].alias(c) for c in keep], "ids", "decoded")


def _missing(table: PieceTable, index):
    joins = _joins(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            for lo, hi, data, offsets in bo.chunked(batch.column("text"), _CHUNK):
                starts, ends, doc = cut_units(data, offsets, joins)
                h = bo.span_hashes(data, starts, ends)
                lost = np.flatnonzero(_find(known, h) < 0)
                o = lost[bo.order_in_groups(doc[lost], h[lost])]
                o = o[bo.first_of_runs(doc[o], h[o])] if len(o) else o
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo).take(pa.array(doc[o])), pa.array([raw[a:b].decode() for a, b in zip(starts[o].tolist(), ends[o].tolist(), strict=True)], pa.string())], names=["row", "unit"])

    return run


def _encode(rows: DataFrame, table: PieceTable, index) -> DataFrame:
    joins, decoder = _joins(table), Decoder.of(table)
    kept = [f for f in rows.schema if f.name not in ("text", "extra")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            others = [batch.schema.get_field_index(f.name) for f in kept]
            for lo, hi, data, offsets in bo.chunked(batch.column("text"), _CHUNK):
                starts, ends, doc = cut_units(data, offsets, joins)
                h = bo.span_hashes(data, starts, ends)
                at = _find(known, h)
                hashes, offs, ids = known
                if len(at) and at.min() < 0:  # units from the join
                    more = {x["unit"]: x["ids"] for r in batch.column("extra").slice(lo, hi - lo).to_pylist() for x in r or ()}
                    mine = _index(_hash_units(pa.array(list(more), pa.string())), np.array([i for v in more.values() for i in v], np.int32), np.array([len(v) for v in more.values()], np.int64))
                    lost = np.flatnonzero(at < 0)
                    found = _find(mine, h[lost])
                    if len(found) and found.min() < 0:
                        raise ValueError("a unit has no pieces: the documents changed while they were encoded")
                    # Only what this chunk uses is put beside the units of the join.
                    used, at = np.unique(np.where(at < 0, 0, at), return_inverse=True)
                    part, size = _gather(ids, offs, used) if len(hashes) else (ids, np.zeros(len(used), np.int64))
                    at[lost] = len(used) + found
                    ids, offs = np.concatenate([part, mine[2]]), np.concatenate([[0], np.cumsum(np.concatenate([size, np.diff(mine[1].astype(np.int64))]))])
                flat, size = _gather(ids, offs, at)
                flat = flat.astype(np.int64)
                total = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=hi - lo))]).astype(np.int64)
                back = decoder.decode(flat).tobytes()
                width = np.diff(decoder.offsets)[flat]
                ends_ = np.concatenate([[0], np.cumsum(width)])[total]
                text = [back[a:b][1:].decode() for a, b in zip(ends_[:-1].tolist(), ends_[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in others), bo.list_array(flat, total, pa.int32()), pa.array(text, pa.string())], names=[*(f.name for f in kept), "ids", "decoded"])

    return rows.mapInArrow(trimmed(run), StructType([*kept, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]))


def decode_ids(spark: SparkSession, encoded: DataFrame, table: PieceTable, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `text`, in place of one of that name: the text of its piece ids (null ids: an empty text)."""
    decoder = Decoder.of(table)
    schema = encoded.select(*[c for c in encoded.columns if c != "text"]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [decoder.decode(np.asarray(i or (), np.int64)).tobytes()[1:].decode(errors="replace") for i in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.select(*schema.names).mapInArrow(run, StructType([*schema, StructField("text", StringType())]))
