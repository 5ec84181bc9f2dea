"""Extension: latency by stage over a stream of spans.

Late spans are accepted up to the watermark; a window is given out once, when it is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, pattern: str = "events.parquet") -> DataFrame:
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def windowed(spans: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``spans(ts, stage, ms)`` to (window_start, stage, n, mean_ms, max_ms)."""
    groups = spans.withWatermark("ts", late).groupBy(F.window("ts", size), "stage")
    return groups.agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms")).select(F.col("window.start").alias("window_start"), "stage", "n", "mean_ms", "max_ms")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is there and stops; output files are exactly-once through the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
