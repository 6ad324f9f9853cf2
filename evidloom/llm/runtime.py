"""Session helpers shared by the operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of known narrow width may be broadcast (8 to 40 bytes each).
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where a local session names no folder (tests, one machine) is a temporary one set; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="evidloom-checkpoint-"))
    return context.getCheckpointDir()


def shared(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions, which the user sizes for the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def semi_by_id(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is in ids; the ids are broadcast only if they are few."""
    ids = ids.select(key).distinct()
    return docs.join(F.broadcast(ids) if fits(ids) else ids, key, "left_semi")


#: Keys with more than one in so many rows are hot; so there are at most as many hot keys.
HOT_KEYS = 1000


def salted_join(rows: DataFrame, table: DataFrame, key: str, count: str, by: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with a table of one row for each key, whose column `count` says how many rows have that key.

    The rows of a hot key are dealt over all partitions by a hash of the columns
    `by`, and its row of the table is repeated for each.  Only the hot keys, at most
    HOT_KEYS by their definition, are broadcast.  The column `count` is dropped.
    """
    if total is None:
        total = table.agg(F.sum(count)).first()[0] or 0
    salts = partitions(rows.sparkSession)
    hot = F.col(count) > F.greatest(F.lit(total / HOT_KEYS), F.lit(1.0))
    few = table.where(hot).select(key, F.lit(True).alias("_hot"))
    rows = rows.join(F.broadcast(few), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    spread = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return rows.join(table.withColumn("_salt", spread).drop(count), [key, "_salt"], how).drop("_salt")


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is not in ids (null keys stay); the ids are broadcast only if they are few."""
    ids = shared(ids.select(key).distinct())
    return docs.join(F.broadcast(ids) if fits(ids) else ids, key, "left_anti").select(*docs.columns)


#: Bytes of an Arrow batch, and the setting's own default.
BATCH_BYTES, _DEFAULT_BYTES = "4m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches: texts run from bytes to megabytes, so a bound on rows alone bounds no memory.

    A bound that the session has set itself stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == _DEFAULT_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def _give_back() -> None:
    """Hand freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, whose worker gives freed memory back when its task ends.

    Spark keeps workers for later tasks, and each would hold on to its largest task's memory beside those at work.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return held


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
