"""Structured Streaming forms of the ledger's incremental work: new files, windowed totals, first appearances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.pages import PAGE


def new_pages(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Page files as they come; finished ones are remembered by the query's checkpoint."""
    return spark.readStream.schema(PAGE).option("multiLine", True).option("maxFilesPerTrigger", files).json(path)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need a timestamp with a time zone; times without one are in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_totals(events: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of tumbling windows; rows later than the watermark are dropped by it, as it says."""
    w = _timed(events, time, late).groupBy(F.window(time, size).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def first_seen(events: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark([key]).select(time, key)


def running_counts(events: DataFrame, key: str) -> DataFrame:
    """Rows of each key so far; for update or complete output."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def upsert(df: DataFrame, checkpoint: str, path: str, once: bool = True) -> StreamingQuery:
    """Appends each batch to a table under its number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
