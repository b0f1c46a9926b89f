"""Continuous variants: tone and volume by day, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_volume(events: DataFrame, *, time: str = "ts", group: str = "event_type", value: str = "value", late: str = "2 days", width: str = "1 day") -> DataFrame:
    """(window_start, group, n, mean_value) of a stream or a table; on a stream, rows later than `late` are dropped by the watermark."""
    stamped = events.withColumn("__time", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("__time", late)
    return stamped.groupBy(F.window("__time", width).alias("w"), F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("window_start"), "group", "n", "mean_value")


def read_events(spark, folder: str, schema) -> DataFrame:  # noqa: ANN001
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def run_once(stream: DataFrame, target: str, checkpoint: str, *, mode: str = "append") -> None:
    """Processes what is there and stops; results are appended as parquet once their window is past the watermark."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
