"""Queries over the unified feed and the headline KPIs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import actions, feed
from .actions import Loops
from .adapters import DOCUMENTS_AS_OF, INVENTORY_AS_OF
from .compliance import RECENT_SQL as RECENT_COMPLIANCE
from .documents import RECENT_SQL as RECENT_DOCUMENTS
from .registry import query

TIE = ["reading_id"]


def _feed(i):
    return feed.unified_feed(i.readings, i.inventory, i.events, i.documents, INVENTORY_AS_OF)


@query("unified_feed", "SELECT event_ts, seq, agent, level, msg FROM feed")
def unified_feed(i):
    return _feed(i).drop("action_badge")


@query("feed_for_agent", "SELECT event_ts, seq, level, msg FROM feed WHERE agent = 'safety'")
def feed_for_agent(i):
    return feed.feed_for_agent(_feed(i), "safety").select("event_ts", "seq", "level", "msg")


@query("top_event_per_agent", """
SELECT agent, event_ts, seq, level FROM feed QUALIFY row_number() OVER (PARTITION BY agent ORDER BY event_ts DESC, seq DESC) = 1""")
def top_event_per_agent(i):
    return feed.top_event_per_agent(_feed(i).select("agent", "event_ts", "seq", "level"))


@query("severity_counts", "SELECT level, count(*) AS events FROM feed GROUP BY level")
def severity_counts(i):
    return feed.severity_counts(_feed(i))


@query("feed_order", "SELECT event_ts, seq, agent, level FROM feed ORDER BY event_ts DESC, seq DESC LIMIT 100")
def feed_order(i):
    """The newest hundred events."""
    return _feed(i).select("event_ts", "seq", "agent", "level").orderBy(*feed.feed_order()).limit(100)


@query("status_digest", """
SELECT level, rank_in_level, event_ts, seq, agent, CASE level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END::BIGINT AS priority
FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY event_ts DESC, seq DESC) AS rank_in_level FROM feed) WHERE rank_in_level <= 5""")
def status_digest(i):
    return feed.status_digest(_feed(i)).select("level", "rank_in_level", "event_ts", "seq", "agent", "priority")


@query("feed_with_actions", """
SELECT agent, level, badge AS action_badge, count(*) AS events FROM (
  SELECT agent, level, NULL::VARCHAR AS badge FROM feed
  UNION ALL SELECT 'equipment', 'CRITICAL', 'DISPATCHED' FROM critical_latest
  UNION ALL SELECT 'safety', 'CRITICAL', 'QUARANTINED' FROM matched
  UNION ALL SELECT 'forecasting', 'HIGH', 'MARKDOWN APPLIED' FROM markdowns) GROUP BY ALL""")
def feed_with_actions(i):
    merged = feed.feed_with_actions(_feed(i), actions.action_events(Loops(i).all))
    return merged.groupBy("agent", "level", "action_badge").agg(F.count("*").alias("events"))


@query("action_events", """
SELECT event_ts, agent, level, msg, action_badge FROM (
  SELECT (SELECT max(ts) FROM events) AS event_ts, 'equipment' AS agent, 'CRITICAL' AS level,
         asset_name || ' maintenance dispatch sent' AS msg, 'DISPATCHED' AS action_badge FROM critical_latest
  UNION ALL SELECT TIMESTAMP '1998-06-30', 'safety', 'CRITICAL',
         'WMS quarantine applied — ' || received_qty || ' units lot #' || lot_number || ' isolated', 'QUARANTINED' FROM matched
  UNION ALL SELECT TIMESTAMP '2001-05-01', 'forecasting', 'HIGH',
         'POS markdown applied — ' || product_name || ' 30% off · $' || format('{:,.2f}', revenue_recovered) || ' revenue recovered',
         'MARKDOWN APPLIED' FROM markdowns)""")
def action_events(i):
    return actions.action_events(Loops(i).all).drop("seq")


@query("kpi_summary", """
WITH latest AS (
  SELECT * FROM readings WHERE asset_type = 'refrigeration'
  QUALIFY row_number() OVER (PARTITION BY sensor_id, metric ORDER BY "timestamp" DESC, reading_id DESC) = 1),
assets AS (SELECT asset_name, bool_and(status = 'NOMINAL') AS ok FROM latest GROUP BY asset_name)
SELECT 'active_skus' AS metric, count(DISTINCT sku_id)::DOUBLE AS value FROM inventory
UNION ALL SELECT 'at_risk_units', sum(qty_on_hand)::DOUBLE FROM high_risk
UNION ALL SELECT 'compliance_pct', round(count_if(status NOT IN ('OPEN', 'ESCALATED')) * 100e0 / count(*), 4) FROM compliance
UNION ALL SELECT 'fleet_uptime_pct', round(count_if(NOT breach) * 100e0 / count(*), 4) FROM readings
UNION ALL SELECT 'document_accuracy_pct', round(count_if(NOT flagged) * 100e0 / count(*), 4) FROM docs
UNION ALL SELECT 'cold_chain_ok', count_if(ok)::DOUBLE FROM assets
UNION ALL SELECT 'cold_chain_total', count(*)::DOUBLE FROM assets""")
def kpi_summary(i):
    return feed.kpi_summary(i.readings, i.inventory, i.events, i.documents, TIE)


@query("telemetry_snapshot", f"""
SELECT 'equipment' AS view, sensor_id || ' ' || metric AS item, status AS state FROM (
  SELECT * FROM readings, (SELECT max(ts) AS now FROM events) WHERE "timestamp" >= now - INTERVAL 2 HOUR AND "timestamp" <= now
  ORDER BY anomaly_score DESC NULLS LAST, "timestamp" DESC, sensor_id, metric LIMIT 50)
UNION ALL
SELECT 'inventory', sku_id, CAST(markdown_recommended AS VARCHAR) FROM (
  SELECT * FROM inventory WHERE spoilage_risk_score > 0.3e0 OR dwell_hours > 48 ORDER BY spoilage_risk_score DESC NULLS LAST, sku_id LIMIT 30)
UNION ALL SELECT 'compliance', event_id, status FROM ({RECENT_COMPLIANCE})
UNION ALL SELECT 'documents', bol_id, status FROM ({RECENT_DOCUMENTS})""")
def telemetry_snapshot(i):
    """The recent views of all four tables as one list; documents are as of their own time."""
    views = feed.telemetry_snapshot({"equipment": i.readings, "inventory": i.inventory, "compliance": i.events}, "all", i.now)
    documents = i.documents_shipped("1998-06-23", DOCUMENTS_AS_OF)
    views |= feed.telemetry_snapshot({"documents": documents}, "documents", DOCUMENTS_AS_OF)
    keys = {
        "equipment": (F.concat_ws(" ", "sensor_id", "metric"), "status"), "inventory": (F.col("sku_id"), "markdown_recommended"),
        "compliance": (F.col("event_id"), "status"), "documents": (F.col("bol_id"), "status")}
    rows = [df.select(F.lit(name).alias("view"), keys[name][0].alias("item"), F.col(keys[name][1]).cast("string").alias("state"))
            for name, df in views.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("kpi_delta", """
WITH latest AS (
  SELECT *, CAST("timestamp" AS DATE) AS day FROM readings WHERE asset_type = 'refrigeration'
  QUALIFY row_number() OVER (PARTITION BY CAST("timestamp" AS DATE), sensor_id, metric ORDER BY "timestamp" DESC, reading_id DESC) = 1),
assets AS (SELECT day, asset_name, bool_and(status = 'NOMINAL') AS ok FROM latest GROUP BY day, asset_name),
kpis AS (
  SELECT CAST(snapshot_timestamp AS DATE) - ago AS day, 'active_skus' AS metric, count(DISTINCT sku_id)::DOUBLE AS value
  FROM inventory, (SELECT unnest([0, 1, 2]) AS ago) WHERE qty_on_hand % 7 >= ago GROUP BY day
  UNION ALL SELECT CAST(snapshot_timestamp AS DATE) - ago AS day, 'at_risk_units', sum(qty_on_hand)::DOUBLE
  FROM high_risk, (SELECT unnest([0, 1, 2]) AS ago) WHERE qty_on_hand % 7 >= ago GROUP BY day
  UNION ALL SELECT day, 'cold_chain_ok', count_if(ok)::DOUBLE FROM assets GROUP BY day
  UNION ALL SELECT day, 'cold_chain_total', count(*)::DOUBLE FROM assets GROUP BY day
  UNION ALL
  SELECT CAST("timestamp" AS DATE) AS day, 'compliance_pct' AS metric,
         round(count_if(status NOT IN ('OPEN', 'ESCALATED')) * 100e0 / count(*), 4) AS value FROM compliance GROUP BY day
  UNION ALL SELECT CAST("timestamp" AS DATE) AS day, 'fleet_uptime_pct', round(count_if(NOT breach) * 100e0 / count(*), 4) FROM readings GROUP BY day
  UNION ALL SELECT shipment_date AS day, 'document_accuracy_pct', round(count_if(NOT flagged) * 100e0 / count(*), 4) FROM docs GROUP BY day)
SELECT day, metric, value, round(value - lag(value) OVER (PARTITION BY metric ORDER BY day), 4) AS delta FROM kpis""")
def kpi_delta(i):
    """Stock of three days: on earlier days some SKUs were not there yet."""
    days = i.inventory.withColumn("_ago", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(F.col("qty_on_hand") % 7 >= F.col("_ago"))
    stock = days.withColumn("snapshot_timestamp", F.col("snapshot_timestamp") - F.make_interval(days=F.col("_ago"))).drop("_ago")
    return feed.kpi_delta(i.readings, stock, i.events, i.documents, TIE)
