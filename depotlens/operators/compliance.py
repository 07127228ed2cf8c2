"""Compliance events: recent and open views, direction, shifts, audits and unresolved breaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import levels
from ..functions.timing import as_ts, days_between, shift_start, time_slice
from . import ordered

# Columns of the recent view.
RECENT_COLUMNS = [
    "event_id", "event_type", "zone", "observed_value", "threshold_value", "unit", "severity", "status",
    "regulation_ref", "timestamp",
]

PROXIMITY_LIMIT_M = 1.5  # fixed value


def recent_compliance(events: DataFrame, as_of=None, hours: int = 24, limit: int = 20) -> DataFrame:
    """Events of the last day, most severe first."""
    rows = time_slice(events, "timestamp", as_of, f"{hours} hours").select(*RECENT_COLUMNS)
    order = [levels.severity_rank("severity").asc(), F.desc("timestamp"), F.asc("event_id")]
    return ordered.top_k(rows, order, limit)


def open_compliance(events: DataFrame) -> DataFrame:
    """The open view with its sort rank as a column; readers order by rank and time."""
    return (
        events.where(F.col("status").isin("OPEN", "ESCALATED"))
        .withColumn("severity_rank", levels.severity_rank("severity"))
    )


def compliance_direction(events: DataFrame) -> DataFrame:
    """Add the violating side, whether the event violates it, the overshoot and a derived severity."""
    directed = events.withColumn("direction", levels.breach_direction("event_type", "unit", "threshold_value"))
    return directed.withColumns({
        "violated": levels.is_violation("observed_value", "threshold_value", "direction"),
        "overshoot": levels.overshoot("observed_value", "threshold_value", "direction"),
        "derived_severity": levels.compliance_severity("event_type", "observed_value", "threshold_value"),
    })


def _proximity(events: DataFrame, limit: float) -> DataFrame:
    return events.where((F.col("event_type") == "proximity_event") & (F.col("observed_value") < limit))


def proximity_by_shift(events: DataFrame, limit: float = PROXIMITY_LIMIT_M, hours: int = 8) -> DataFrame:
    """Proximity events below the limit per asset and shift."""
    return (
        _proximity(events, limit)
        .groupBy("asset_id", F.window("timestamp", f"{hours} hours").alias("_w"))
        .agg(F.count("*").alias("events"), F.min("observed_value").alias("closest"))
        .select("asset_id", F.col("_w.start").alias("shift_start"), "events", "closest")
    )


def event_ordinal_in_shift(events: DataFrame, limit: float = PROXIMITY_LIMIT_M, hours: int = 8,
                           slice_seconds: int = ordered.SLICE_SECONDS) -> DataFrame:
    """Position of each proximity event within its asset's shift ("third this shift")."""
    rows = _proximity(events, limit).withColumn("shift_start", shift_start("timestamp", hours))
    return ordered.with_ordinal(rows, ["asset_id", "shift_start"], "timestamp", ["event_id"],
                                "ordinal", slice_seconds)


def days_since_last(events: DataFrame, as_of=None, event_type: str = "haccp_audit", cycle_days: int = 60) -> DataFrame:
    """Per asset: days since its last event of a type, days left in the cycle and an overdue flag."""
    today = F.to_date(as_ts(as_of))
    last = events.where(F.col("event_type") == event_type).groupBy("asset_id").agg(F.max("timestamp").alias("last_at"))
    aged = last.withColumn("days_since", days_between(today, F.to_date("last_at")))
    due = F.lit(cycle_days).cast("long") - F.col("days_since")
    return aged.withColumn("due_in", due).withColumn("overdue", F.col("due_in") < 0)


def certificates_due(events: DataFrame, within_days: float = 14) -> DataFrame:
    """Assets whose latest certificate reading says it expires within the horizon."""
    certs = events.where(F.col("event_type") == "cert_expiry")
    latest = ordered.newest_per(certs, ["asset_id"], ["timestamp", "event_id"],
                                ["asset_id", "event_id", "observed_value", "timestamp"])
    return latest.where(F.col("observed_value") <= within_days).select(
        "asset_id", "event_id", F.col("observed_value").alias("days_left"), "timestamp")


def unresolved_after(events: DataFrame, hours: int = 1, breach_type: str = "temperature_breach",
                     slice_seconds: int = ordered.SLICE_SECONDS) -> DataFrame:
    """Breaches that no resolved event of the same asset follows within the SLA; they escalate.

    A resolved event is one with status RESOLVED; it counts at ``resolved_at``, else at its own time.
    """
    rows = events.withColumn("_resolved", F.col("status") == "RESOLVED").withColumn(
        "_at", F.when(F.col("_resolved"), F.coalesce("resolved_at", "timestamp")).otherwise(F.col("timestamp")))
    rows = rows.where(F.col("_resolved") | (F.col("event_type") == breach_type))
    seen = ordered.next_within(rows, ["asset_id"], "_at", F.col("_resolved"), hours * 3600, "resolved_by", slice_seconds)
    late = F.col("resolved_by").isNull() | (F.col("resolved_by") > F.col("timestamp") + F.expr(f"interval {hours} hours"))
    return (
        seen.where((F.col("event_type") == breach_type) & ~F.col("_resolved") & late)
        .withColumn("status", F.lit("ESCALATED")).drop("_resolved", "_at", "resolved_by")
    )
