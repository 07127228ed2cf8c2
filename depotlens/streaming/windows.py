"""Windowed aggregates over reading streams. All accept batch frames too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

WATERMARK = "10 minutes"


def _flat(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *columns)


def breach_counts_tumbling(readings: DataFrame, width: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Readings and breaches per metric and tumbling window."""
    breach = F.coalesce(scoring.is_breach("value", "threshold", "baseline"), F.lit(False))
    grouped = (
        readings.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", width).alias("_w"), "metric")
        .agg(F.count("*").alias("readings"), F.count_if(breach).alias("breaches"))
    )
    return _flat(grouped, "metric", "readings", "breaches")


def readings_sliding(readings: DataFrame, width: str = "2 hours", step: str = "15 minutes",
                     watermark: str = WATERMARK) -> DataFrame:
    """Count, mean and maximum per metric over sliding windows."""
    grouped = (
        readings.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", width, step).alias("_w"), "metric")
        .agg(F.count("*").alias("readings"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    )
    return _flat(grouped, "metric", "readings", "mean_value", "max_value")


def breach_sessions(readings: DataFrame, gap: str = "6 hours", watermark: str = WATERMARK) -> DataFrame:
    """Sessions of breaching readings per sensor that lie no more than ``gap`` apart."""
    grouped = (
        readings.withWatermark("timestamp", watermark)
        .where(scoring.is_breach("value", "threshold", "baseline"))
        .groupBy(F.session_window("timestamp", gap).alias("_w"), "sensor_id")
        .agg(F.count("*").alias("breaches"), F.max("value").alias("max_value"))
    )
    return _flat(grouped, "sensor_id", "breaches", "max_value")
