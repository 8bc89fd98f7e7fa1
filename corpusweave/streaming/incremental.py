"""Incremental corpora: landed files become new rows once, and tables take them exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.text import content_hash


def landed(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over the Parquet files that land in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def new_content(stream: DataFrame, url: str, raw: str, time: str | None = None, late: str = "7 days") -> DataFrame:
    """Rows whose content hasn't come before; with a time column the state is bounded by the watermark."""
    rows = stream.withColumn("content_hash", content_hash(F.col(url), F.col(raw)))
    if time:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])
    return rows.dropDuplicates(["content_hash"])


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Processes all that has landed and stops; ``write`` gets each batch and its number."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A writer that gives each batch its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def turn_counts(messages: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Messages by role in event-time windows; an extension, for monitoring."""
    return messages.withWatermark(time, late).groupBy(F.window(time, window), "role").agg(F.count(F.lit(1)).alias("n"))
