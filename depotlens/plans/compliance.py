"""Queries over compliance events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels
from ..operators import compliance, feed
from .registry import query

_RANK = "CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END"

RECENT_SQL = f"""
  SELECT event_id, event_type, zone, observed_value, threshold_value, unit, severity, status, regulation_ref, "timestamp"
  FROM compliance, (SELECT max(ts) AS now FROM events)
  WHERE "timestamp" >= now - INTERVAL 24 HOUR AND "timestamp" <= now
  ORDER BY {_RANK}, "timestamp" DESC, event_id LIMIT 20"""


@query("recent_compliance", f"SELECT * REPLACE (round(observed_value, 6) AS observed_value) FROM ({RECENT_SQL})")
def recent_compliance(i):
    return compliance.recent_compliance(i.events, i.now)


@query("open_compliance", f"""
SELECT event_id, severity, status, "timestamp", ({_RANK})::BIGINT AS severity_rank FROM compliance WHERE status IN ('OPEN', 'ESCALATED')""")
def open_compliance(i):
    return compliance.open_compliance(i.events).select("event_id", "severity", "status", "timestamp", "severity_rank")


@query("compliance_direction", """
SELECT event_id, direction, violated, round(greatest(CASE direction WHEN 'above' THEN observed_value - threshold_value
       ELSE threshold_value - observed_value END, 0e0), 6) AS overshoot,
       CASE WHEN NOT violated THEN 'LOW' WHEN event_type = 'recall_match' THEN 'CRITICAL'
            WHEN event_type = 'temperature_breach' AND threshold_value >= 0 THEN 'HIGH'
            WHEN event_type IN ('temperature_breach', 'proximity_event') THEN 'MEDIUM' ELSE 'LOW' END AS derived_severity
FROM (SELECT *, CASE direction WHEN 'above' THEN observed_value > threshold_value ELSE observed_value < threshold_value END AS violated
      FROM (SELECT *, CASE WHEN event_type = 'temperature_breach' AND threshold_value < 0 THEN 'below'
                           WHEN event_type IN ('proximity_event', 'cert_expiry') THEN 'below' ELSE 'above' END AS direction
            FROM compliance))""")
def compliance_direction(i):
    return compliance.compliance_direction(i.events).select("event_id", "direction", "violated", "overshoot", "derived_severity")


@query("compliance_severity", """
SELECT event_type, derived, count(*) AS events FROM (
  SELECT event_type, CASE
    WHEN event_type = 'recall_match' AND observed_value > threshold_value THEN 'CRITICAL'
    WHEN event_type = 'temperature_breach' AND threshold_value >= 0 AND observed_value > threshold_value THEN 'HIGH'
    WHEN event_type = 'temperature_breach' AND threshold_value < 0 AND observed_value < threshold_value THEN 'MEDIUM'
    WHEN event_type = 'proximity_event' AND observed_value < threshold_value THEN 'MEDIUM' ELSE 'LOW' END AS derived
  FROM compliance) GROUP BY event_type, derived""")
def compliance_severity(i):
    derived = levels.compliance_severity("event_type", "observed_value", "threshold_value")
    return i.events.groupBy("event_type", derived.alias("derived")).agg(F.count("*").alias("events"))


@query("severity_rank", f"""
SELECT event_id, severity, ({_RANK})::BIGINT AS severity_rank FROM (SELECT event_id, CASE WHEN status = 'DOCUMENTED' THEN NULL ELSE severity END AS severity FROM compliance)""")
def severity_rank(i):
    """Ranks with some severities unknown."""
    known = F.when(F.col("status") != "DOCUMENTED", F.col("severity"))
    return i.events.select("event_id", known.alias("severity"), levels.severity_rank(known).alias("severity_rank"))


@query("proximity_by_shift", """
SELECT asset_id, time_bucket(INTERVAL 8 HOUR, "timestamp", TIMESTAMP '1970-01-01') AS shift_start, count(*) AS events,
       round(min(observed_value), 6) AS closest
FROM compliance WHERE event_type = 'proximity_event' AND observed_value < 1.5e0 GROUP BY asset_id, shift_start""")
def proximity_by_shift(i):
    return compliance.proximity_by_shift(i.events)


@query("event_ordinal_in_shift", """
SELECT event_id, asset_id, shift_start, row_number() OVER (PARTITION BY asset_id, shift_start ORDER BY "timestamp", event_id) AS ordinal
FROM (SELECT *, time_bucket(INTERVAL 8 HOUR, "timestamp", TIMESTAMP '1970-01-01') AS shift_start FROM compliance
      WHERE event_type = 'proximity_event' AND observed_value < 1.5e0)""")
def event_ordinal_in_shift(i):
    return compliance.event_ordinal_in_shift(i.events).select("event_id", "asset_id", "shift_start", "ordinal")


@query("days_since_last", """
SELECT asset_id, last_at, days_since, 60 - days_since AS due_in, 60 - days_since < 0 AS overdue
FROM (SELECT asset_id, max("timestamp") AS last_at,
             CAST(date_diff('day', CAST(max("timestamp") AS DATE), DATE '2024-03-15') AS BIGINT) AS days_since
      FROM compliance WHERE event_type = 'haccp_audit' GROUP BY asset_id)""")
def days_since_last(i):
    return compliance.days_since_last(i.events, "2024-03-15")


@query("certificates_due", """
SELECT asset_id, event_id, observed_value AS days_left, "timestamp" FROM (
  SELECT * FROM compliance WHERE event_type = 'cert_expiry'
  QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY "timestamp" DESC, event_id DESC) = 1)
WHERE observed_value <= 14""")
def certificates_due(i):
    return compliance.certificates_due(i.events)


@query("unresolved_after", """
SELECT event_id, asset_id, "timestamp", 'ESCALATED' AS status FROM compliance b
WHERE event_type = 'temperature_breach' AND status <> 'RESOLVED' AND NOT EXISTS (
  SELECT 1 FROM compliance r WHERE r.asset_id = b.asset_id AND r.status = 'RESOLVED'
  AND r."timestamp" >= b."timestamp" AND r."timestamp" <= b."timestamp" + INTERVAL 1 HOUR)""")
def unresolved_after(i):
    return compliance.unresolved_after(i.events).select("event_id", "asset_id", "timestamp", "status")


@query("grounding_compliance", f"SELECT 'safety' AS agent, event_id, severity FROM ({RECENT_SQL})")
def grounding_compliance(i):
    rows = compliance.recent_compliance(i.events, i.now)
    packed = feed.grounding_context(rows, "safety", [levels.severity_rank("severity").asc(), F.desc("timestamp"), F.asc("event_id")])
    schema = "array<struct<event_id: string, severity: string>>"
    return packed.select("agent", F.explode(F.from_json("context", schema)).alias("r")).select("agent", "r.*")
