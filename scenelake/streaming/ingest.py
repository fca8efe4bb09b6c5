"""New captions as a stream: tagging is a projection of each row, so the batch expressions serve unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scenelake.functions import rules


def tag_stream(spark: SparkSession, folder: str, schema: str = "clip_id long, text string, at timestamp") -> DataFrame:
    """Tags of captions that arrive as Parquet files."""
    return spark.readStream.schema(schema).parquet(folder).select("clip_id", "at", *rules.tags(F.col("text")))


def windowed_counts(tags: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Clips by hour and hazard level; rows later than the watermark are left out."""
    return tags.withWatermark("at", late).groupBy(F.window("at", window), "hazard_level").agg(F.count("*").alias("n"))


def start(tags: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet folder until all files that are there have been read."""
    return tags.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
