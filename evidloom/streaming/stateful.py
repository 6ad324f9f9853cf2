"""Streams over append-only observations: end-pointing, latest knowledge, sliding failures, late knowledge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graphs import checkpoint_folder


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """A table of the driver as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{table}.parquet*")


def endpointer(start_after: int, end_after: int) -> Callable[..., Iterator[pd.DataFrame]]:
    """State function for applyInPandasWithState: (key, kind, frame_no) of starts and ends.

    The state is (open, run of speech, run of silence, last frame); frames at or
    before the last one seen are repeats and are ignored.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, loud, quiet, last = state.get if state.exists else (False, 0, 0, -1)
        out = []
        rows = pd.concat(list(frames)).sort_values("frame_no")
        for frame, speech in zip(rows["frame_no"].tolist(), rows["speech"].tolist(), strict=True):
            if frame <= last:
                continue
            last = frame
            loud, quiet = (loud + 1, 0) if speech else (0, quiet + 1)
            if not open_ and loud >= start_after:
                open_ = True
                out.append((key[0], "start", frame))
            elif open_ and quiet >= end_after:
                open_ = False
                out.append((key[0], "end", frame))
        state.update((open_, loud, quiet, last))
        yield pd.DataFrame(out, columns=["stream_id", "kind", "frame_no"])

    return step


def endpoints(frames: DataFrame, start_after: int = 3, end_after: int = 19) -> DataFrame:
    """Starts and ends of utterances over a stream of (stream_id, frame_no, speech)."""
    return frames.groupBy("stream_id").applyInPandasWithState(endpointer(start_after, end_after), "stream_id long, kind string, frame_no long", "open boolean, loud long, quiet long, last long", "append", GroupStateTimeout.NoTimeout)


def windowed_failures(events: DataFrame, at: str, key: str, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Failures per key over sliding windows; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def known_by(observations: DataFrame, as_of: str, recorded: str = "recorded_at", observed: str = "observed_at", late: str = "30 days") -> DataFrame:
    """Observations whose knowledge time is not after as_of; event time only bounds the state, it does not filter."""
    return observations.where(F.col(recorded) <= F.lit(as_of).cast("timestamp")).withWatermark(observed, late)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is available now, as a table in the shared checkpoint folder; a restart resumes from its checkpoint."""
    spark = stream.sparkSession
    where = f"{checkpoint_folder(spark)}/streams/{name}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/data").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/data")


def upsert_batches(stream: DataFrame, name: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """foreachBatch: each micro-batch is merged with the table of the batch before, and written as a new version.

    A log in the shared folder names the versions that are whole.  A restart goes
    on from the last of them; a batch that comes again is not merged twice.
    """
    spark = stream.sparkSession
    where = f"{checkpoint_folder(spark)}/streams/{name}"

    def last(below: int | None = None) -> int | None:
        try:
            log = spark.read.schema("number long").parquet(f"{where}/log")
        except AnalysisException:  # no batch yet
            return None
        return log.where(F.col("number") < below if below is not None else F.lit(True)).agg(F.max("number")).first()[0]

    def step(batch: DataFrame, number: int) -> None:
        if last(number + 1) == number:
            return
        before = last(number)
        merge(batch, spark.read.parquet(f"{where}/v{before}") if before is not None else None).write.mode("overwrite").parquet(f"{where}/v{number}")
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(f"{where}/log")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    number = last()
    return spark.read.parquet(f"{where}/v{number}") if number is not None else merge(spark.createDataFrame([], stream.schema), None)
