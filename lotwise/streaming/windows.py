"""Event-time counts over streams, with a bound on late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, at: str = "ts", kind: str = "event_type", length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """How many events of each kind a window has; a window is final once the watermark passes its end."""
    return events.withWatermark(at, delay).groupBy(F.window(at, length), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def run_available(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has now into Parquet below ``path``, and read the result."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
