"""Sensor readings: recent view, breaches, latest state, scores, episodes and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.timing import time_slice
from . import ordered

# Columns of the recent view.
RECENT_COLUMNS = [
    "sensor_id", "asset_name", "zone", "metric", "value", "baseline", "threshold", "unit", "status",
    "anomaly_score", "timestamp",
]


def recent_equipment(readings: DataFrame, as_of=None, hours: int = 2, limit: int = 50) -> DataFrame:
    """Readings of the last two hours, most anomalous first."""
    rows = time_slice(readings, "timestamp", as_of, f"{hours} hours").select(*RECENT_COLUMNS)
    order = [F.desc("anomaly_score"), F.desc("timestamp"), F.asc("sensor_id"), F.asc("metric")]
    return ordered.top_k(rows, order, limit)


def threshold_breach(readings: DataFrame) -> DataFrame:
    """Breaching readings with a status recomputed from value, threshold and baseline."""
    status = scoring.reading_status("value", "threshold", "baseline")
    return readings.withColumn("status", status).where(F.col("status") != "NOMINAL")


def with_status(readings: DataFrame) -> DataFrame:
    return readings.withColumn("status", scoring.reading_status("value", "threshold", "baseline"))


def with_scores(readings: DataFrame) -> DataFrame:
    """Add percent from baseline and the threshold-relative anomaly score."""
    return readings.withColumns({
        "pct_from_baseline": scoring.pct_from_baseline("value", "baseline"),
        "anomaly_score": scoring.anomaly_score("value", "baseline", "threshold"),
    })


def latest_per_sensor(readings: DataFrame, tie: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Newest reading per (sensor, metric), reduced to ``columns``."""
    return ordered.newest_per(readings, ["sensor_id", "metric"], ["timestamp", *(tie or ["value"])], columns)


def readings_with_spec(readings: DataFrame, spec: DataFrame) -> DataFrame:
    """Attach baseline and threshold by (asset_type, metric); readings without a spec keep nulls.

    The dimension is small; whether it is broadcast is left to its measured size.
    """
    rows = readings.drop("baseline", "threshold")
    return rows.join(spec.select("asset_type", "metric", "baseline", "threshold"), ["asset_type", "metric"], "left")


def rolling_zscore(readings: DataFrame, tie: list[str], size: int = 50,
                   slice_seconds: int = ordered.SLICE_SECONDS, chunk_rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Z-score of each value against the ``size`` readings before it from the same sensor."""
    numbered = ordered.with_ordinal(readings, ["sensor_id"], "timestamp", tie, "_n", slice_seconds)
    stats = {"rolling_count": F.count("value"), "rolling_mean": F.avg("value"), "rolling_stddev": F.stddev_samp("value")}
    scored = ordered.over_previous(numbered, ["sensor_id"], "_n", size, stats, chunk_rows).drop("_n")
    return scored.withColumn("zscore", F.try_divide(F.col("value") - F.col("rolling_mean"), F.col("rolling_stddev")))


def breach_episodes(readings: DataFrame, tie: list[str], keys: list[str] | None = None,
                    slice_seconds: int = ordered.SLICE_SECONDS) -> DataFrame:
    """Contiguous breach runs per sensor and metric with start, end, minutes and worst value.

    Worst is the value furthest past the threshold, whichever side the threshold guards.
    """
    keys = keys or ["sensor_id", "metric"]
    upper = F.coalesce(F.col("threshold") > F.col("baseline"), F.lit(False))
    marked = readings.withColumn("_breach", scoring.is_breach("value", "threshold", "baseline"))
    found = ordered.runs(marked, keys, "timestamp", tie, "_breach", {
        "started_at": ("min", F.col("timestamp")),
        "ended_at": ("max", F.col("timestamp")),
        "n_readings": ("sum", F.lit(1).cast("long")),
        "_high": ("max", F.when(upper, F.col("value"))),
        "_low": ("min", F.when(~upper, F.col("value"))),
    }, slice_seconds)
    minutes = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / F.lit(60e6)
    return found.select(*keys, "started_at", "ended_at", "n_readings", minutes.alias("minutes"),
                        F.coalesce("_high", "_low").alias("worst_value"))


def _fleet_counts(readings: DataFrame, groups: list[str], tie: list[str] | None) -> DataFrame:
    """Per group: assets in total and by the worst status among the group's latest readings."""
    level = F.when(F.col("status") == "CRITICAL", 2).when(F.col("status") == "WARNING", 1).otherwise(0)
    keys = [*groups, "asset_name", "sensor_id", "metric"]
    latest = ordered.newest_per(with_status(readings), keys, ["timestamp", *(tie or ["value"])], [*keys, "status"])
    assets = latest.groupBy(*groups, "asset_name").agg(F.max(level).alias("_level"))
    return assets.groupBy(*groups).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("_level") == n).alias(name) for n, name in enumerate(["nominal", "warning", "critical"])],
    )


def fleet_status(readings: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Per asset type: assets in total and by the worst status among their latest readings."""
    return _fleet_counts(readings, ["asset_type"], tie)


def fleet_status_by_day(readings: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """``fleet_status`` over all given assets per day, from each day's latest readings."""
    return _fleet_counts(readings.withColumn("day", F.to_date("timestamp")), ["day"], tie)


def sensor_profile(readings: DataFrame) -> DataFrame:
    """Exact count, mean, standard deviation, median and 95th percentile per metric.

    Percentiles interpolate linearly. They are read off a distributed running count over distinct
    values, so a metric that holds most rows is never sorted or buffered in one task.
    """
    basics = readings.groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"),
    )
    counts = readings.where(F.col("value").isNotNull()).groupBy("metric", "value").agg(F.count("*").alias("_c"))
    running = ordered.prefix_sums(counts, [F.col("metric"), F.col("value")], {"_before": F.col("_c")}, "profile")
    starts = running.groupBy("metric").agg(F.min("_before").alias("_start"), F.sum("_c").alias("_n"))
    starts = ordered.rekeyed(starts, "metric", "_metric")
    placed = running.join(starts, F.col("metric") == F.col("_metric")).withColumn("_pos", F.col("_before") - F.col("_start"))
    picks = []
    for name, q in (("p50", 0.5e0), ("p95", 0.95e0)):
        exact = F.lit(q) * (F.col("_n") - 1)
        for side, at in (("lo", F.floor(exact)), ("hi", F.ceil(exact))):
            holds = (F.col("_pos") <= at) & (at < F.col("_pos") + F.col("_c"))
            picks.append(F.max(F.when(holds, F.col("value"))).alias(f"_{name}_{side}"))
    quantiles = placed.groupBy("metric", "_n").agg(*picks)
    out = []
    for name, q in (("p50", 0.5e0), ("p95", 0.95e0)):
        exact = F.lit(q) * (F.col("_n") - 1)
        part = exact - F.floor(exact)
        out.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * part).alias(name))
    return basics.join(quantiles.select("metric", *out), "metric", "left")


def sensor_profile_approx(readings: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One-pass sketch profile: approximate distinct sensors and percentiles per metric."""
    quantiles = F.percentile_approx("value", [0.5, 0.95], accuracy)
    return readings.groupBy("metric").agg(
        F.count("value").alias("n"),
        F.approx_count_distinct("sensor_id").alias("sensors_approx"),
        quantiles.getItem(0).alias("p50_approx"),
        quantiles.getItem(1).alias("p95_approx"),
    )
