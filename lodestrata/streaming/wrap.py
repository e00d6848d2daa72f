"""Optional streaming forms: events counted in windows with late data, repeated events dropped, batches handed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n): the same for a batch and, in append mode, for a stream."""
    t = events.withColumn(time, F.col(time).cast("timestamp"))
    w = t.withWatermark(time, late) if t.isStreaming else t
    return w.groupBy(F.window(time, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def once(events: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Repeated events dropped, within the watermark on a stream."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_batches(stream: DataFrame, pipeline: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch through the batch pipeline into a folder of its own, so a repeated batch replaces itself."""

    def one(batch: DataFrame, epoch: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
