"""Event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.events import EVENT_SCHEMA, shape_events, valid_events


def event_source(spark: SparkSession, path: str, fmt: str = "json", schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def event_stream(events: DataFrame, log_dir: str, checkpoint: str):
    """Valid events, redacted, into one folder per UTC day; exactly once through the file sink."""
    out = shape_events(valid_events(events))
    return (
        out.writeStream.format("json").partitionBy("date").option("path", log_dir)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def event_dashboard(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed counts and latency per component (an event-time extension)."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window), "component")
        .agg(F.count("*").alias("n"), F.avg("latency_ms").alias("avg_latency"))
        .select(F.col("window.start").alias("window_start"), "component", "n", "avg_latency")
    )
