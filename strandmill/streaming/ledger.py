"""A ledger that grows, summarised as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)


def windowed_summary(events: DataFrame, at: str, group: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and sum of value for each window and group; windows close once the watermark has passed them."""
    w = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), group, "n", "total")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what is there now to Parquet, exactly once, and stops."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
