"""Live bars: ticks in, closed bars out once the watermark has passed their close; late and repeated ticks are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_bars(ticks: DataFrame, length: int, late: str = "10 minutes", point: float = 0.01) -> DataFrame:
    """Bars of series, ts, event_id, value, points from a stream (or a table, for which the result is that of a batch)."""
    seen = ticks.withWatermark("ts", late)
    seen = seen.dropDuplicatesWithinWatermark(["event_id"]) if ticks.isStreaming else seen.dropDuplicates(["event_id"])
    at = F.struct("ts", "event_id")  # equal times go by event_id
    x = seen.groupBy("series", F.window("ts", f"{length} minutes").alias("w")).agg(
        F.min_by("value", at).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", at).alias("c"), F.count(F.lit(1)).alias("tv"), (F.max_by("points", at) * point).alias("spread"),
    )
    return x.select("series", F.col("w.start").alias("start"), "o", "h", "l", "c", "tv", "spread")
