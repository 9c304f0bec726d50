"""Streams: sessions by inactivity, ingestion without repeats and expiry. The batch forms take the same plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def sessions(events: DataFrame, gap: str = "2 hours", key: str = "user_id", time: str = "ts", watermark: str | None = None) -> DataFrame:
    """(key, start, end, n): runs of events of a key without a gap. With a watermark it is for streams; late events are dropped by it."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("_t", watermark)
    g = rows.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, time: str = "ts", by: str = "event_type", watermark: str | None = None) -> DataFrame:
    """(start, by, n, value): tumbling or sliding windows."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("_t", watermark)
    g = rows.groupBy(F.window("_t", width, slide or width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", "value")


def ingest(stream: DataFrame, sink, key: str = "id", time: str = "created_at", late: str = "1 day", checkpoint: str | None = None):
    """Start a query that redacts facts, drops repeated ids within the watermark and gives micro-batches to sink(df, n)."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")
    writer = rows.withColumn("content", X.redact(F.col("content"))).writeStream.foreachBatch(sink).outputMode("append").trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
