"""Streaming ingest: files as they arrive become documents, and events become windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pliego.sources.loaders import append_new


def documents_stream(spark: SparkSession, path: str, schema: str = "doc_id string, content string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def append_documents(stream: DataFrame, table: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Appends arriving rows to a table, each key once also when a batch is run again."""
    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, table, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
