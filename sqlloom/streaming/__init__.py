"""Record streams: ingestion of new records without repeats, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark's delay; state is bounded by it."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, group: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Records by window and group, closed by the watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, window), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to a table, partitioned by batch, so that a batch done again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
