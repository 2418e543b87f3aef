"""Structured Streaming: windowed counts with a watermark, and deduplication by hash within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_folder


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    got = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return got.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})  # a watermark needs an instant


def run(df: DataFrame, name: str) -> DataFrame:
    """Drives a streaming frame over all that is there, in append mode, to files in the shared folder, and reads these."""
    spark, base = df.sparkSession, shared_folder(df.sparkSession, name)
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and kind; a window leaves when the watermark has passed its end."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("period"), "event_type", "n", "total")


def first_of_key(events: DataFrame, key: str, delay: str = "30 days") -> DataFrame:
    """One event for each key within the watermark's delay: idempotent intake by content hash."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
