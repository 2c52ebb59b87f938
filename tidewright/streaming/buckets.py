"""The resampling aggregation on a stream: means and sums per time bucket, late rows dropped beyond the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_stream(stream: DataFrame, time: str, column: str, minutes: int, lateness: str = "10 minutes") -> DataFrame:
    """bucket, n, mean and sum of the valid values; for append mode, a bucket comes out once the watermark has passed it."""
    at = stream.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", lateness)
    out = at.groupBy(F.window("__at", f"{minutes} minutes")).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.sum(column).alias("sum"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "n", "mean", "sum")
