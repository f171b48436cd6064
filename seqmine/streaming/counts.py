"""Running counts while a stream is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_counts(sdf: DataFrame, *, ts: str = "ts", name: str = "class", window: str = "1 day",
                  delay: str = "1 hour") -> DataFrame:
    """Records per class and tumbling window; rows behind the watermark are dropped."""
    return (sdf.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("_w"), name)
            .agg(F.count(F.lit(1)).alias("records"))
            .select(F.col("_w.start").alias("window_start"), name, "records"))
