"""A live batch: recognised items arrive as files, item rows and batch counts are kept up to date.

An extension of the batch operators: the same functions run on each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofmark.sources.readers import OCR_SCHEMA


def arrivals(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Recognition results as they arrive, JSON lines in a folder."""
    return spark.readStream.schema(OCR_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def states(arrived: DataFrame) -> DataFrame:
    """Each item's state: an item with errors is in error, any other completed."""
    bad = F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0
    return arrived.select("item_id", "profile", F.when(bad, "ERROR").otherwise("COMPLETED").alias("processing_state"), "processing_time_ms")


def counts(arrived: DataFrame) -> DataFrame:
    """Running counts by state."""
    return states(arrived).groupBy("processing_state").agg(F.count("*").alias("n"), F.sum("processing_time_ms").alias("total_ms"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts per window of event time (column ``ts``) and kind; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def run(spark: SparkSession, source: str, items_path: str, checkpoint: str) -> StreamingQuery:
    """Appends item rows to a table, once each, until the folder has been read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{items_path}/batch_id={batch_id}")

    return states(arrivals(spark, source)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
