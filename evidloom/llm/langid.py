"""Language by compression: a zstandard dictionary of raw text for each language; the smallest output wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import fits

#: Matches of 3 bytes count, or short texts would find nothing in a dictionary.
PARAMETERS = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 3, "min_match": 3, "target_length": 32, "strategy": 4}
#: Letters stay (A-Z lower-cased); other ASCII becomes a space, so that layout and junk teach no language.
_LETTERS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _plain(raw: bytes) -> bytes:
    return b" ".join(raw.translate(_LETTERS_ONLY).split())


UNKNOWN = "und"
#: Bins of the hash by which training texts are chosen.
_BINS = 1 << 16
_PART = 1 << 8


def train(docs: DataFrame, dictionary_bytes: int = 100_000, text_bytes: int = 4_096, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries: whole texts of each language until `dictionary_bytes` are reached.

    Texts of 64 to `text_bytes` bytes come first, by hash of the id and text;
    then longer ones, the shortest first, and shorter ones.  So every language of
    a text with a letter is learned, and at most `dictionary_bytes` and one text
    of each pass through the driver.  Null texts and languages are left out; a
    text of two languages' rows teaches both; repeated rows teach once; other
    columns are ignored; an empty table teaches nothing.
    """
    size = F.octet_length("text")
    slim = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key")).where("text is not null and text <> '' and lang is not null")
    usual = F.pmod("key", F.lit(_BINS))
    longer = F.lit(_BINS) + F.floor(F.log2(size) * 64)
    place = F.when(size < 64, F.lit(2 * _BINS) - size).when(size > text_bytes, longer).otherwise(usual).cast("long")
    # Bytes by bins of that order, without texts: a few rows say up to which bin a language has enough.
    ranked = slim.select("lang", "key", size.cast("long").alias("size"), place.alias("bin"))
    # Bytes before a bin: those before its part of the bins, and those inside it; no window holds more than some hundred rows.
    running = lambda keys, at: F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = ranked.groupBy("lang", "bin").agg(F.sum("size").alias("size")).withColumn("part", F.expr(f"bin div {_PART}"))
    parts = bins.groupBy("lang", "part").agg(F.sum("size").alias("size")).select("lang", "part", running(["lang"], "part").alias("earlier"))
    bins = bins.withColumn("inside", running(["lang", "part"], "bin")).join(parts, ["lang", "part"])
    bins = bins.where(F.col("earlier") + F.col("inside") < dictionary_bytes).groupBy("lang").agg(F.max("bin").alias("upto"))
    near = ranked.distinct().join(F.broadcast(bins) if fits(bins) else bins, "lang").where("bin <= upto")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("bin", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = near.withColumn("before", before).where(F.col("before") < dictionary_bytes).select("lang", "key", "bin")
    taken = slim.join(F.broadcast(chosen) if fits(chosen) else chosen, ["lang", "key"]).groupBy("lang", "bin", "key").agg(F.min("text").alias("text"))
    out: dict[str, list[bytes]] = {}
    for row in taken.orderBy("lang", "bin", "key").select("lang", "text").collect():
        out.setdefault(row["lang"], []).append(_plain(row["text"].encode()))
    order = [r["lang"] for r in slim.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    return {k: d for k in order if (d := b" ".join(out[k]).strip())}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, from the whole text.

    The score falls with the runner-up's nearness: 1 - 2 ** -(bits saved per 8
    bytes), 0 to 1.  A text is rejected if the best language saves less than
    `margin` of the runner-up's size; the best is still given.  Null texts and
    texts without a letter are `und` with score 0; ties go to the first dictionary,
    which training puts in the order of the languages' document counts.
    Repeated rows are judged each, null ids too; very long texts are compressed
    whole; other columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        setting = zstandard.ZstdCompressionParameters(write_checksum=False, write_content_size=False, write_dict_id=False, **PARAMETERS)
        packers = []
        for k in names:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=setting)
            packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=setting))
        for batch in batches:
            pred, score, reject = [], [], []
            for text, ok in zip(batch.column("text"), batch.column("letters").to_pylist(), strict=True):
                if not ok or not names:
                    pred.append(UNKNOWN), score.append(0.0), reject.append(True)
                    continue
                raw = _plain(text.as_buffer().to_pybytes())
                size = np.array([len(p.compress(raw)) for p in packers])
                order = np.argsort(size, kind="stable")
                best, next_ = (size[order[0]], size[order[1]]) if len(names) > 1 else (size[0], size[0] + len(raw))
                pred.append(names[order[0]])
                score.append(float(1 - 2.0 ** -((next_ - best) * 64 / max(1, len(raw)))))
                reject.append(bool(next_ - best < margin * next_))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
