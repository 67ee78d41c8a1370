"""Incremental ingest of rating files: a file stream whose checkpoint remembers what has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ratings(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New CSV files of a folder as a stream."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is new to a Parquet table and stops; run again to resume."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def mean_by_window(stream: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean rating by key and time window; state older than the watermark goes."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return grouped.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "mean", "n")
