"""Queries over action loops and their log."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scoring import money
from ..functions.text import action_key, reasoning_excerpt, trigger_match
from ..functions.timing import parse_iso_utc
from ..operators import actions, equipment
from ..operators.inventory import high_risk_inventory
from ..operators.ordered import over_previous, prefix_sums
from ..sources import action_log
from ..sources.scratch import new_path
from .adapters import (
    CONVERSATION_PRICE_WORDS,
    CONVERSATION_TRIGGERS,
    DOCUMENTS_AS_OF,
    INVENTORY_AS_OF,
)
from .registry import query

TIE = ["reading_id"]


class Loops:
    """The three loops over one set of inputs."""

    def __init__(self, inputs):
        self.i = inputs

    @cached_property
    def dispatches(self):
        return actions.equipment_dispatch(self.i.readings, self.i.now, TIE)

    @cached_property
    def quarantines(self):
        return actions.wms_quarantine(self.i.recalls, self.i.documents, DOCUMENTS_AS_OF)

    @cached_property
    def markdowns(self):
        return actions.pos_markdown(self.i.inventory, INVENTORY_AS_OF)

    @cached_property
    def all(self):
        return self.dispatches.unionByName(self.quarantines).unionByName(self.markdowns)


@query("equipment_dispatch", """
SELECT 'equipment_dispatch' AS loop, 'DISPATCHED' AS status, (SELECT max(ts) FROM events) AS "timestamp", asset_name AS asset, zone,
       metric, value, baseline, round((value - baseline) / baseline * 100e0, 6) AS pct_from_baseline,
       'Dispatch maintenance technician immediately.' AS recommendation FROM critical_latest""")
def equipment_dispatch(i):
    return Loops(i).dispatches.select("loop", "status", "timestamp", "asset", "zone", "metric", "value", "baseline",
                                      "pct_from_baseline", "recommendation")


@query("wms_quarantine", """
SELECT 'QUARANTINED' AS status, bol_id, lot_number, vendor, product_name AS product, received_qty AS units_quarantined,
       'Receiving Dock' AS location, classification AS recall_class, matched_recall AS recall_number, '21 CFR 7.3(m)' AS regulation,
       TIMESTAMP '1998-06-30' AS quarantined_at FROM matched""")
def wms_quarantine(i):
    return Loops(i).quarantines.select("status", "bol_id", "lot_number", "vendor", "product", "units_quarantined", "location",
                                       "recall_class", "recall_number", "regulation", "quarantined_at")


@query("pos_markdown", """
SELECT sku_id, product_name, zone, unit_price AS original_price, 30e0 AS markdown_pct, new_price, qty_on_hand AS units_affected,
       spoilage_risk_score, days_to_expiry, revenue_at_risk, revenue_recovered, TIMESTAMP '2001-05-01' AS effective_at,
       TIMESTAMP '2001-05-01 08:00:00' AS expires_at, 'MARKDOWN APPLIED' AS status FROM markdowns""")
def pos_markdown(i):
    return Loops(i).markdowns.select(
        "sku_id", "product_name", "zone", "original_price", "markdown_pct", "new_price", "units_affected", "spoilage_risk_score",
        "days_to_expiry", "revenue_at_risk", "revenue_recovered", "effective_at", "expires_at", "status")


@query("markdown_price", """
SELECT sku_id, round(unit_price * (1e0 - CASE WHEN days_to_expiry < 0 THEN 50e0 WHEN days_to_expiry <= 2 THEN 30e0 ELSE 10e0 END / 100e0), 2) AS new_price
FROM inventory""")
def markdown_price(i):
    """Every SKU at a discount that grows as it nears expiry."""
    pct = F.when(F.col("days_to_expiry") < 0, 50e0).when(F.col("days_to_expiry") <= 2, 30e0).otherwise(10e0)
    return i.inventory.select("sku_id", scoring.markdown_price("unit_price", pct).alias("new_price"))


@query("revenue_at_risk", """
SELECT zone, count(*) AS skus, round(sum(round(unit_price * qty_on_hand, 2)), 2) AS at_risk FROM high_risk GROUP BY zone""")
def revenue_at_risk(i):
    """Revenue at risk of high-risk stock per zone."""
    priced = high_risk_inventory(i.inventory).withColumn("at_risk", scoring.revenue("unit_price", "qty_on_hand"))
    return priced.groupBy("zone").agg(F.count("*").alias("skus"), F.round(F.sum("at_risk"), 2).alias("at_risk"))


def _staggered(i):
    """Markdowns whose start follows the SKU's dwell time, so that some have run out."""
    start = F.col("effective_at") - F.make_interval(hours=F.col("days_to_expiry").cast("int") * 3 + 4)
    return Loops(i).markdowns.withColumn("effective_at", start).withColumn(
        "expires_at", F.col("effective_at") + F.expr("interval 8 hours"))


_ACTIVE = """markdowns WHERE TIMESTAMP '2001-05-01' - to_hours(CAST(days_to_expiry * 3 + 4 AS INTEGER)) <= TIMESTAMP '2001-05-01'
  AND TIMESTAMP '2001-05-01' < TIMESTAMP '2001-05-01' - to_hours(CAST(days_to_expiry * 3 + 4 AS INTEGER)) + INTERVAL 8 HOUR"""


@query("active_markdowns", f"SELECT sku_id, days_to_expiry, new_price FROM {_ACTIVE}")
def active_markdowns(i):
    return actions.active_markdowns(_staggered(i), INVENTORY_AS_OF).select("sku_id", "days_to_expiry", "new_price")


@query("markdown_summary", f"""
SELECT count(*) AS markdowns, sum(qty_on_hand)::BIGINT AS units, round(sum(revenue_at_risk), 2) AS revenue_at_risk,
       round(sum(revenue_recovered), 2) AS revenue_recovered FROM {_ACTIVE}""")
def markdown_summary(i):
    return actions.markdown_summary(actions.active_markdowns(_staggered(i), INVENTORY_AS_OF))


@query("markdown_recovery_by_category", """
SELECT category, round(sum(revenue_at_risk), 2) AS revenue_at_risk, round(sum(revenue_recovered), 2) AS revenue_recovered,
       round(sum(revenue_recovered) / sum(revenue_at_risk), 6) AS recovery_ratio FROM markdowns GROUP BY category""")
def markdown_recovery_by_category(i):
    return actions.markdown_recovery_by_category(Loops(i).markdowns, i.inventory)


@query("trigger_match", """
SELECT conv_id, turn, f.loop FROM turns t LEFT JOIN fired f ON f.request_id = t.conv_id || '-' || t.turn WHERE role = 'assistant'""")
def trigger_match_query(i):
    return i.turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", trigger_match("agent", "text", CONVERSATION_TRIGGERS, CONVERSATION_PRICE_WORDS).alias("loop"))


@query("actions_from_conversations", """
SELECT request_id, loop, text AS agent_response, CASE loop WHEN 'equipment_dispatch' THEN 'R-12' END AS asset,
       CASE loop WHEN 'equipment_dispatch' THEN 'Compressor cycle time' END AS metric, CASE loop WHEN 'equipment_dispatch' THEN '340ms' END AS value,
       CASE loop WHEN 'equipment_dispatch' THEN '290ms' END AS baseline, CASE loop WHEN 'wms_quarantine' THEN 'RLT-2024-0891' END AS lot_number,
       CASE loop WHEN 'equipment_dispatch' THEN NULL ELSE 340 END::BIGINT AS units, CASE loop WHEN 'pos_markdown' THEN 12.99e0 END AS original_price
FROM fired""")
def actions_from_conversations(i):
    """Requests of conversation turns, with the payload each loop carries."""
    requests = actions.actions_from_conversations(i.turns, CONVERSATION_TRIGGERS, CONVERSATION_PRICE_WORDS)
    data = F.from_json("data", actions.REQUEST_SCHEMA)
    return requests.select("request_id", "loop", "agent_response", *[
        data[name].alias(name) for name in ("asset", "metric", "value", "baseline", "lot_number", "units", "original_price")])


def _requests(i):
    """Requests built from stock, readings and documents, some fields left out, and one loop unknown."""
    md = i.inventory.select(
        F.concat(F.lit("m-"), "sku_id").alias("request_id"),
        F.when(F.col("category") == "SMALL", "price_match").otherwise("pos_markdown").alias("loop"),
        F.to_json(F.struct("sku_id", F.col("unit_price").alias("original_price"),
                           F.when(F.col("days_to_expiry") > 0, F.col("qty_on_hand")).alias("units"))).alias("data"))
    eq = i.readings.select(
        F.concat(F.lit("e-"), "reading_id").alias("request_id"), F.lit("equipment_dispatch").alias("loop"),
        F.to_json(F.struct(F.col("asset_name").alias("asset"), "metric",
                           F.format_string("%.2fms", "value").alias("value"), F.lit("50ms").alias("baseline"))).alias("data"))
    qr = i.documents.select(
        F.concat(F.lit("q-"), "bol_id").alias("request_id"), F.lit("wms_quarantine").alias("loop"),
        F.to_json(F.struct("bol_id", "lot_number", "vendor", F.col("product_name").alias("product"),
                           F.when(F.col("received_qty") > 0, F.col("received_qty")).alias("units"))).alias("data"))
    return md.unionByName(eq).unionByName(qr).withColumn("agent_response", F.lit(None).cast("string"))


@query("route_triggers", """
SELECT loop, status, sku_id, product_name, original_price, new_price, units_affected, revenue_recovered, asset, zone, value, pct_from_baseline,
       bol_id, lot_number, vendor, units_quarantined, location, recall_class
FROM (
  SELECT 'pos_markdown' AS loop, 'MARKDOWN APPLIED' AS status, sku_id, 'Atlantic Salmon Fillets 2lb' AS product_name,
         unit_price AS original_price, round(unit_price * (1e0 - 30e0 / 100e0), 2) AS new_price,
         CASE WHEN days_to_expiry > 0 THEN qty_on_hand ELSE 340 END AS units_affected,
         round(round(unit_price * (1e0 - 30e0 / 100e0), 2) * CASE WHEN days_to_expiry > 0 THEN qty_on_hand ELSE 340 END, 2) AS revenue_recovered,
         NULL::VARCHAR AS asset, 'Meat & Seafood' AS zone, NULL::DOUBLE AS value, NULL::DOUBLE AS pct_from_baseline, NULL::VARCHAR AS bol_id,
         NULL::VARCHAR AS lot_number, NULL::VARCHAR AS vendor, NULL::BIGINT AS units_quarantined, NULL::VARCHAR AS location, NULL::VARCHAR AS recall_class
  FROM inventory WHERE category <> 'SMALL'
  UNION ALL
  SELECT 'equipment_dispatch', 'DISPATCHED', NULL, NULL, NULL, NULL, NULL, NULL, asset_name, 'Dairy Zone', value,
         round((value - 50e0) / 50e0 * 100e0, 6), NULL, NULL, NULL, NULL, NULL, NULL FROM readings
  UNION ALL
  SELECT 'wms_quarantine', 'QUARANTINED', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, bol_id, lot_number, vendor,
         CASE WHEN received_qty > 0 THEN received_qty ELSE 340 END, 'Receiving Dock — Bay 3', 'Class II' FROM docs)""")
def route_triggers(i):
    routed, _ = actions.route_triggers(_requests(i), INVENTORY_AS_OF)
    return routed.select("loop", "status", "sku_id", "product_name", "original_price", "new_price", "units_affected",
                         "revenue_recovered", "asset", "zone", "value", "pct_from_baseline", "bol_id", "lot_number", "vendor",
                         "units_quarantined", "location", "recall_class")


@query("route_rejects", """
SELECT 'm-' || sku_id AS request_id, 'price_match' AS loop, 'Unknown loop: price_match' AS reason FROM inventory WHERE category = 'SMALL'""")
def route_rejects(i):
    return actions.route_triggers(_requests(i), INVENTORY_AS_OF)[1]


@query("loop_trace", """
SELECT loop, step_no, step, label, detail FROM (
  SELECT loop, 1::BIGINT AS step_no, 'trigger' AS step, CASE loop WHEN 'equipment_dispatch' THEN 'Sensor Anomaly Detected'
         WHEN 'wms_quarantine' THEN 'FDA Recall Match Detected' ELSE 'Spoilage Risk Threshold Exceeded' END AS label,
         CASE loop WHEN 'equipment_dispatch' THEN 'asset: R-12, metric: Compressor cycle time, value: 340.00, baseline: 290.00, pct from baseline: 17.2'
         WHEN 'wms_quarantine' THEN 'recall class: Class II, lot number: RLT-2024-0891, bol id: BOL-74808'
         ELSE 'product name: Atlantic Salmon Fillets 2lb, days to expiry: 2, units affected: 340, spoilage risk score: 0.870' END AS detail FROM fired
  UNION ALL
  SELECT loop, 2, 'reasoning', CASE loop WHEN 'equipment_dispatch' THEN 'Equipment Agent Reasoning'
         WHEN 'wms_quarantine' THEN 'Safety Agent Reasoning' ELSE 'Forecasting Agent Reasoning' END, substr(text, 1, 180) || '…' FROM fired
  UNION ALL
  SELECT loop, 3, 'action', CASE loop WHEN 'equipment_dispatch' THEN 'Maintenance Dispatch Sent'
         WHEN 'wms_quarantine' THEN 'WMS Quarantine Record Written' ELSE 'POS Price Update Applied' END,
         CASE loop WHEN 'equipment_dispatch' THEN 'recommendation: Dispatch maintenance technician immediately. Inspect compressor valve and capacitor.'
         WHEN 'wms_quarantine' THEN 'product: Romaine Lettuce (bagged), lot number: RLT-2024-0891, units quarantined: 340'
         ELSE 'product name: Atlantic Salmon Fillets 2lb, original price: 12.99, new price: 9.09, markdown pct: 30' END FROM fired
  UNION ALL
  SELECT loop, 4, 'result', 'Loop Closed',
         CASE loop WHEN 'equipment_dispatch' THEN 'status: DISPATCHED, zone: Dairy Zone'
         WHEN 'wms_quarantine' THEN 'status: QUARANTINED, location: Receiving Dock — Bay 3'
         ELSE 'status: MARKDOWN APPLIED, revenue recovered: 3090.60, revenue at risk: 4416.60' END FROM fired)""")
def loop_trace(i):
    """Traces of the actions that conversations fire."""
    requests = actions.actions_from_conversations(i.turns, CONVERSATION_TRIGGERS, CONVERSATION_PRICE_WORDS)
    return actions.loop_trace(actions.route_triggers(requests, INVENTORY_AS_OF)[0]).drop("action_id")


@query("loop_trace_steps", """
SELECT loop, step, n FROM (
  SELECT 'equipment_dispatch' AS loop, count(*) AS n FROM critical_latest UNION ALL SELECT 'wms_quarantine', count(*) FROM matched
  UNION ALL SELECT 'pos_markdown', count(*) FROM markdowns), (SELECT unnest(['trigger', 'reasoning', 'action', 'result']) AS step)""")
def loop_trace_steps(i):
    return actions.loop_trace(Loops(i).all).groupBy("loop", "step").agg(F.count("*").alias("n"))


@query("append_actions", """
SELECT loop, type, count(*) AS entries FROM (
  SELECT 'equipment_dispatch' AS loop, NULL::VARCHAR AS type FROM critical_latest
  UNION ALL SELECT 'wms_quarantine', unnest([NULL, 'quarantine']) FROM matched
  UNION ALL SELECT 'pos_markdown', unnest([NULL, 'markdown']) FROM markdowns) GROUP BY loop, type""")
def append_actions(i):
    """The action log written by all three loops and read back: entries by loop and type."""
    path = new_path(i.spark, "action-log")
    loops = Loops(i)
    for frame in (loops.dispatches, loops.quarantines, loops.markdowns):
        action_log.append_actions(frame, path)
    return action_log.read_actions(i.spark, path).groupBy("loop", "type").agg(F.count("*").alias("entries"))


@query("read_actions", """
WITH done AS (
  SELECT 'equipment_dispatch' AS loop, NULL::VARCHAR AS record, (SELECT max(ts) FROM events) AS "timestamp" FROM critical_latest
  UNION ALL SELECT 'wms_quarantine', 'quarantine', TIMESTAMP '1998-06-30' FROM matched
  UNION ALL SELECT 'pos_markdown', 'markdown', TIMESTAMP '2001-05-01' FROM markdowns),
numbered AS (SELECT *, row_number() OVER (ORDER BY "timestamp") AS action FROM done)
SELECT row_number() OVER (ORDER BY action, seq) AS n, loop, CASE seq WHEN 0 THEN record END AS type, "timestamp", true AS in_order
FROM numbered, (SELECT unnest([0, 1]) AS seq) WHERE seq = 1 OR record IS NOT NULL""")
def read_actions(i):
    """Every entry of the whole log in log order, numbered without a global window; ids only have to ascend within a time."""
    path = new_path(i.spark, "action-log")
    loops = Loops(i)
    for frame in (loops.dispatches, loops.quarantines, loops.markdowns):
        action_log.append_actions(frame, path)
    entries = action_log.read_actions(i.spark, path).select("timestamp", "action_id", "seq", "loop", "type")
    numbered = prefix_sums(entries, action_log.log_order(), {"_before": 1}, "log-order")
    key = F.struct("timestamp", "action_id", "seq")
    placed = over_previous(numbered.select("*", (F.col("_before") + 1).alias("n")).drop("_before"), [], "n", 1, {"last": F.max(key)})
    in_order = F.col("last").isNull() | (F.col("last") < key)
    return placed.select("n", "loop", "type", "timestamp", in_order.alias("in_order"))


@query("dispatch_outbox", """
SELECT 'equipment_critical' AS kind, asset_name || ' — ' || zone AS asset_line,
       metric || ': ' || printf('%.2f', value) || ' vs ' || printf('%.2f', baseline) || ' baseline' AS anomaly_line,
       'Dispatch maintenance technician immediately.' AS recommendation,
       'FDA 21 CFR 117 cold chain violation if unaddressed within 1 hour' AS compliance_line FROM critical_latest""")
def dispatch_outbox(i):
    """Outbox payloads written, read back and unpacked."""
    path = new_path(i.spark, "outbox")
    action_log.write_outbox(actions.dispatch_outbox(Loops(i).dispatches), path)
    schema = "asset_line string, anomaly_line string, recommendation string, compliance_line string"
    return i.spark.read.parquet(path).select("kind", F.from_json("payload", schema).alias("p")).select("kind", "p.*")


@query("dispatch_outbox_other", """
SELECT 'equipment_warning' AS kind, 'Alert: equipment_warning — ' || asset_name || ' — ' || zone || ' ' || metric || ': ' || printf('%.2f', value)
       || ' vs ' || printf('%.2f', baseline) || ' baseline' AS text FROM critical_latest""")
def dispatch_outbox_other(i):
    """Kinds other than the critical one carry a line of text."""
    path = new_path(i.spark, "outbox")
    action_log.write_outbox(actions.dispatch_outbox(Loops(i).dispatches, "equipment_warning"), path)
    return i.spark.read.parquet(path).select("kind", F.from_json("payload", "text string").alias("p")).select("kind", "p.text")


@query("equipment_dispatch_low", """
SELECT asset_name AS asset, metric, value, "timestamp" AS seen FROM (
  SELECT * FROM (SELECT *, value >= 60 AS hit, abs(value - 60) > abs(60 - baseline) AS critical FROM readings WHERE metric <> 'view')
  WHERE hit AND critical QUALIFY row_number() OVER (PARTITION BY sensor_id, metric ORDER BY "timestamp" DESC, reading_id DESC) = 1)""")
def equipment_dispatch_low(i):
    """Dispatches at a lower threshold, where sensors breach again and again and only the newest breach counts."""
    low = i.readings.where(F.col("metric") != "view").withColumn("threshold", F.lit(60e0))
    fired = actions.equipment_dispatch(equipment.with_status(low), i.now, TIE).select("asset", "metric", "value", "action_id")
    times = low.select(F.unix_micros("timestamp").alias("micros"), "sensor_id", F.col("metric").alias("m"), F.col("timestamp").alias("seen"))
    keyed = times.select(action_key("ACT", F.lit("equipment_dispatch"), "sensor_id", "m", F.col("micros")).alias("action_id"), "seen").distinct()
    return fired.join(keyed, "action_id").drop("action_id")


@query("reasoning_excerpt", "SELECT conv_id, turn, substr(text, 1, 180) || '…' AS excerpt FROM conversations")
def reasoning_excerpt_query(i):
    return i.table("conversations").select("conv_id", "turn", reasoning_excerpt("text").alias("excerpt"))


@query("money", "SELECT sku_id, '$' || format('{:,.2f}', revenue_at_risk) AS at_risk FROM markdowns")
def money_query(i):
    return Loops(i).markdowns.select("sku_id", money("revenue_at_risk").alias("at_risk"))


@query("parse_iso_utc", """SELECT event_id, ts FROM events""")
def parse_iso_utc_query(i):
    """Event times rendered as ISO text with microseconds and parsed back."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return i.raw_events.select("event_id", parse_iso_utc(text).alias("ts"))


@query("deterministic_action_id", """
SELECT count(*) AS actions, count(*) AS distinct_ids, count(*) AS prefixed FROM readings""")
def deterministic_action_id(i):
    """Ids of all readings are distinct and carry their prefix."""
    ids = i.readings.select(action_key("ACT", "sensor_id", "metric", F.unix_micros("timestamp")).alias("id"))
    return ids.agg(F.count("*").alias("actions"), F.count_distinct("id").alias("distinct_ids"),
                   F.count_if(F.col("id").rlike("^ACT-[0-9A-F]{32}$")).alias("prefixed"))
