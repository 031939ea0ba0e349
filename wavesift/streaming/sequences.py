"""The engine's only use of streams: sequences that grow, summarised by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scores(stream: DataFrame, time: str = "ts", key: str = "user_id", value: str = "value", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count, mean, least and greatest value of each key in each window; rows later than the watermark are dropped."""
    by = stream.withWatermark(time, late).groupBy(F.window(time, width), key)
    return by.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
