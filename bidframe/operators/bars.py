"""Price bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def price_bars(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """First, highest, lowest and last price, volume and number of ticks per ticker and bucket; ties in time by event_id. Partial aggregates meet in one shuffle, so a busy ticker is no burden."""
    order = F.struct("ts", "event_id")
    return ticks.groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.min_by("close", order).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_ticks"),
    ).select("ticker", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume", "n_ticks")
