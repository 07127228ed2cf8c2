"""Action loops: dispatch, quarantine and markdown records, routing, traces and log entries.

Every loop yields rows of one wide ``actions`` frame (see ``schemas.ACTION_LOG``). Ids are hashes of
the trigger key, so a replayed batch writes the same ids.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import scoring
from ..functions.levels import severity_rank
from ..functions.text import LOOP_OF_AGENT, action_key, reasoning_excerpt, trigger_match
from ..functions.timing import as_ts
from . import equipment, inventory, recalls

# Status each loop ends in.
STATUS = {
    "equipment_dispatch": "DISPATCHED",
    "wms_quarantine": "QUARANTINED",
    "pos_markdown": "MARKDOWN APPLIED",
}

# Record fields that are the same on every row.
RECOMMENDATION = "Dispatch maintenance technician immediately."
COMPLIANCE_RISK = "FDA 21 CFR 117 cold chain violation if unaddressed within 1 hour"
REGULATION = "21 CFR 7.3(m)"
MARKDOWN_PCT = 30.0
MARKDOWN_HOURS = 8

# What a request takes for a field it does not carry.
REQUEST_DEFAULTS = {
    "equipment_dispatch": {"asset": "R-12", "zone": "Dairy Zone", "recommendation": RECOMMENDATION},
    "wms_quarantine": {
        "bol_id": "BOL-74808", "lot_number": "RLT-2024-0891", "vendor": "Fresh Express",
        "product": "Romaine Lettuce (bagged)", "units": 340, "location": "Receiving Dock — Bay 3",
        "recall_class": "Class II", "recall_number": "F-2024-0033",
    },
    "pos_markdown": {
        "sku_id": "SKU-4821", "product_name": "Atlantic Salmon Fillets 2lb", "zone": "Meat & Seafood",
        "original_price": 12.99, "markdown_pct": 30.0, "units": 340, "spoilage_score": 0.87, "days_to_expiry": 2,
    },
}

# What a conversation sends with the loop it fires.
CONVERSATION_PAYLOADS = {
    "equipment_dispatch": {
        "asset": "R-12", "metric": "Compressor cycle time", "value": "340ms", "baseline": "290ms", "zone": "Dairy Zone",
        "recommendation": f"{RECOMMENDATION} Inspect compressor valve and capacitor.",
    },
    "wms_quarantine": REQUEST_DEFAULTS["wms_quarantine"],
    "pos_markdown": REQUEST_DEFAULTS["pos_markdown"],
}

REQUEST_SCHEMA = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("asset", T.StringType()), ("zone", T.StringType()), ("metric", T.StringType()),
        ("value", T.StringType()), ("baseline", T.StringType()), ("recommendation", T.StringType()),
        ("bol_id", T.StringType()), ("lot_number", T.StringType()), ("vendor", T.StringType()),
        ("product", T.StringType()), ("units", T.LongType()), ("location", T.StringType()),
        ("recall_class", T.StringType()), ("recall_number", T.StringType()),
        ("sku_id", T.StringType()), ("product_name", T.StringType()), ("original_price", T.DoubleType()),
        ("markdown_pct", T.DoubleType()), ("spoilage_score", T.DoubleType()), ("days_to_expiry", T.LongType()),
    ]
])

ACTION_COLUMNS = [f.name for f in schemas.ACTION_LOG.fields if f.name not in ("type", "seq")]


def _conform(df: DataFrame) -> DataFrame:
    """All action columns, in order and typed; columns the loop does not fill are null."""
    have = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.ACTION_LOG.fields if f.name in ACTION_COLUMNS
    ]
    extra = [F.col("agent_response")] if "agent_response" in have else [F.lit(None).cast("string").alias("agent_response")]
    return df.select(*cols, *extra)


def equipment_dispatch(readings: DataFrame, as_of=None, tie: list[str] | None = None) -> DataFrame:
    """A dispatch per (sensor, metric) whose newest breach is CRITICAL-grade."""
    breaches = equipment.threshold_breach(readings).where(F.col("status") == "CRITICAL")
    columns = ["sensor_id", "metric", "timestamp", "asset_name", "zone", "value", "baseline"]
    rows = equipment.latest_per_sensor(breaches, tie, columns)
    return _conform(rows.select(
        action_key("ACT", F.lit("equipment_dispatch"), "sensor_id", "metric", F.unix_micros("timestamp")).alias("action_id"),
        F.lit("equipment_dispatch").alias("loop"), as_ts(as_of).alias("timestamp"),
        F.lit(STATUS["equipment_dispatch"]).alias("status"), F.col("asset_name").alias("asset"), "zone", "metric",
        "value", "baseline", scoring.pct_from_baseline("value", "baseline").alias("pct_from_baseline"),
        F.lit(RECOMMENDATION).alias("recommendation"),
    ))


def wms_quarantine(recall_rows: DataFrame, documents: DataFrame, as_of=None, location: str = "Receiving Dock") -> DataFrame:
    """A quarantine record per (document, recall) lot match."""
    rows = recalls.recall_match(recall_rows, documents)
    key = [F.col("bol_id"), F.col("matched_recall")]
    return _conform(rows.select(
        action_key("ACT", F.lit("wms_quarantine"), *key).alias("action_id"),
        F.lit("wms_quarantine").alias("loop"), as_ts(as_of).alias("timestamp"),
        F.lit(STATUS["wms_quarantine"]).alias("status"), action_key("QRN", *key).alias("quarantine_id"),
        "bol_id", "lot_number", "vendor", F.col("product_name").alias("product"),
        F.coalesce("received_qty", "invoiced_qty").alias("units_quarantined"), F.lit(location).alias("location"),
        F.col("classification").alias("recall_class"), F.col("matched_recall").alias("recall_number"),
        F.lit(REGULATION).alias("regulation"), F.lit("Safety Agent (automated)").alias("quarantined_by"),
        as_ts(as_of).alias("quarantined_at"),
    ))


def pos_markdown(stock: DataFrame, as_of=None, pct: float = MARKDOWN_PCT, price: str = "unit_price") -> DataFrame:
    """A markdown record per SKU that qualifies, with new price and revenue at risk and recovered."""
    rows = inventory.markdown_candidates(stock)
    new_price = scoring.markdown_price(price, F.lit(pct))
    return _conform(rows.select(
        action_key("ACT", F.lit("pos_markdown"), "sku_id", F.unix_micros(as_ts(as_of))).alias("action_id"),
        F.lit("pos_markdown").alias("loop"), as_ts(as_of).alias("timestamp"),
        F.lit(STATUS["pos_markdown"]).alias("status"),
        action_key("MKD", "sku_id", F.unix_micros(as_ts(as_of))).alias("markdown_id"), "sku_id", "product_name", "zone",
        F.col(price).alias("original_price"), F.lit(pct).alias("markdown_pct"), new_price.alias("new_price"),
        F.col("qty_on_hand").alias("units_affected"), "spoilage_risk_score", "days_to_expiry",
        scoring.revenue(price, "qty_on_hand").alias("revenue_at_risk"),
        scoring.revenue(new_price, "qty_on_hand").alias("revenue_recovered"),
        F.lit("Forecasting Agent (automated)").alias("markdown_by"), as_ts(as_of).alias("effective_at"),
        (as_ts(as_of) + F.expr(f"interval {MARKDOWN_HOURS} hours")).alias("expires_at"),
    ))


def active_markdowns(markdowns: DataFrame, as_of=None) -> DataFrame:
    """Markdowns with ``effective_at <= as_of < expires_at``."""
    now = as_ts(as_of)
    expires = F.coalesce("expires_at", F.col("effective_at") + F.expr(f"interval {MARKDOWN_HOURS} hours"))
    return markdowns.where((F.col("effective_at") <= now) & (now < expires))


def markdown_summary(markdowns: DataFrame) -> DataFrame:
    return markdowns.agg(
        F.count("*").alias("markdowns"), F.sum("units_affected").alias("units"),
        F.round(F.sum("revenue_at_risk"), 2).alias("revenue_at_risk"),
        F.round(F.sum("revenue_recovered"), 2).alias("revenue_recovered"))


def markdown_recovery_by_category(markdowns: DataFrame, stock: DataFrame) -> DataFrame:
    """Recovered over at-risk revenue per category."""
    rows = markdowns.join(stock.select("sku_id", "category"), "sku_id")
    at_risk, recovered = F.sum("revenue_at_risk"), F.sum("revenue_recovered")
    return rows.groupBy("category").agg(
        F.round(at_risk, 2).alias("revenue_at_risk"), F.round(recovered, 2).alias("revenue_recovered"),
        F.round(F.try_divide(recovered, at_risk), 6).alias("recovery_ratio"))


def route_triggers(requests: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """Split requests ``(request_id, loop, data, agent_response)`` into actions and rejects.

    ``data`` is a JSON object; fields it lacks take the loop's defaults. An unknown loop becomes a
    rejected row with a reason.
    """
    known = F.coalesce(F.col("loop").isin(list(STATUS)), F.lit(False))
    rejects = requests.where(~known).select(
        "request_id", "loop", F.concat(F.lit("Unknown loop: "), F.coalesce("loop", F.lit("null"))).alias("reason"))
    parsed = requests.where(known).withColumn("d", F.from_json(F.coalesce("data", F.lit("{}")), REQUEST_SCHEMA))

    def field(loop: str, name: str) -> Column:
        default = REQUEST_DEFAULTS[loop].get(name)
        return F.col(f"d.{name}") if default is None else F.coalesce(F.col(f"d.{name}"), F.lit(default))

    def number(name: str) -> Column:
        return F.regexp_extract(F.col(f"d.{name}"), r"^\s*(-?[0-9]+(\.[0-9]+)?)", 1).try_cast("double")

    now = as_ts(as_of)

    def common(loop: str) -> list[Column]:
        return [action_key("ACT", "loop", "request_id").alias("action_id"), F.col("loop"), now.alias("timestamp"),
                F.lit(STATUS[loop]).alias("status"), F.col("agent_response")]

    loop = "equipment_dispatch"
    dispatch = parsed.where(F.col("loop") == loop).select(
        *common(loop), field(loop, "asset").alias("asset"), field(loop, "zone").alias("zone"),
        F.col("d.metric").alias("metric"), number("value").alias("value"), number("baseline").alias("baseline"),
        scoring.pct_from_baseline(number("value"), number("baseline")).alias("pct_from_baseline"),
        field(loop, "recommendation").alias("recommendation"))
    loop = "wms_quarantine"
    quarantine = parsed.where(F.col("loop") == loop).select(
        *common(loop), action_key("QRN", "loop", "request_id").alias("quarantine_id"),
        *[field(loop, c).alias(c) for c in ("bol_id", "lot_number", "vendor", "product", "location", "recall_class", "recall_number")],
        field(loop, "units").alias("units_quarantined"), F.lit(REGULATION).alias("regulation"),
        F.lit("Safety Agent (automated)").alias("quarantined_by"), now.alias("quarantined_at"))
    loop = "pos_markdown"
    price, pct, units = (field(loop, c) for c in ("original_price", "markdown_pct", "units"))
    new_price = scoring.markdown_price(price, pct)
    markdown = parsed.where(F.col("loop") == loop).select(
        *common(loop), action_key("MKD", "loop", "request_id").alias("markdown_id"),
        *[field(loop, c).alias(c) for c in ("sku_id", "product_name", "zone", "days_to_expiry")],
        price.alias("original_price"), pct.alias("markdown_pct"), new_price.alias("new_price"),
        units.alias("units_affected"), field(loop, "spoilage_score").alias("spoilage_risk_score"),
        scoring.revenue(price, units).alias("revenue_at_risk"), scoring.revenue(new_price, units).alias("revenue_recovered"),
        F.lit("Forecasting Agent (automated)").alias("markdown_by"), now.alias("effective_at"),
        (now + F.expr(f"interval {MARKDOWN_HOURS} hours")).alias("expires_at"))
    actions = reduce(lambda a, b: a.unionByName(b), [_conform(x) for x in (dispatch, quarantine, markdown)])
    return actions, rejects


def actions_from_conversations(turns: DataFrame, triggers: dict[str, list[str]] | None = None,
                               price_words: list[str] | None = None) -> DataFrame:
    """Requests fired by assistant turns ``(conv_id, turn, role, agent, text)``, at most one per turn."""
    payload = F.lit(None).cast("string")
    for name, fields in CONVERSATION_PAYLOADS.items():
        payload = F.when(F.col("loop") == name, json.dumps(fields, ensure_ascii=False)).otherwise(payload)
    fired = (
        turns.where((F.col("role") == "assistant") & (F.length("text") > 0))
        .withColumn("loop", trigger_match("agent", "text", triggers, price_words))
    )
    return fired.where(F.col("loop").isNotNull()).select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), "loop", payload.alias("data"), F.col("text").alias("agent_response"))


def _text(column: str, decimals: int | None = None) -> Column:
    value = F.col(column)
    shown = value.cast("string") if decimals is None else F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value))
    return F.coalesce(shown, F.lit("n/a"))


def _fields(*columns: str, **decimals: int) -> Column:
    """``name: value`` of columns, parted by commas; ``decimals`` names numbers and their places."""
    shown = [(c, _text(c)) for c in columns] + [(c, _text(c, n)) for c, n in decimals.items()]
    return F.concat_ws(", ", *[F.concat(F.lit(name.replace("_", " ") + ": "), value) for name, value in shown])


def loop_trace(actions: DataFrame) -> DataFrame:
    """Four rows per action: trigger, reasoning, action and result with a label and a detail made of the action's columns."""
    # The step labels.
    steps = {
        "equipment_dispatch": [
            ("Sensor Anomaly Detected", _fields("asset", "metric", value=2, baseline=2, pct_from_baseline=1)),
            ("Equipment Agent Reasoning", reasoning_excerpt("agent_response")),
            ("Maintenance Dispatch Sent", _fields("recommendation")),
            ("Loop Closed", _fields("status", "zone")),
        ],
        "wms_quarantine": [
            ("FDA Recall Match Detected", _fields("recall_class", "lot_number", "bol_id")),
            ("Safety Agent Reasoning", reasoning_excerpt("agent_response")),
            ("WMS Quarantine Record Written", _fields("product", "lot_number", "units_quarantined")),
            ("Loop Closed", _fields("status", "location")),
        ],
        "pos_markdown": [
            ("Spoilage Risk Threshold Exceeded", _fields("product_name", "days_to_expiry", "units_affected", spoilage_risk_score=3)),
            ("Forecasting Agent Reasoning", reasoning_excerpt("agent_response")),
            ("POS Price Update Applied", _fields("product_name", original_price=2, new_price=2, markdown_pct=0)),
            ("Loop Closed", _fields("status", revenue_recovered=2, revenue_at_risk=2)),
        ],
    }
    names = ["trigger", "reasoning", "action", "result"]

    def array_of(loop: str) -> Column:
        return F.array(*[
            F.struct(F.lit(i).cast("long").alias("step_no"), F.lit(names[i - 1]).alias("step"), F.lit(label).alias("label"), detail.alias("detail"))
            for i, (label, detail) in enumerate(steps[loop], 1)])

    chosen = (
        F.when(F.col("loop") == "equipment_dispatch", array_of("equipment_dispatch"))
        .when(F.col("loop") == "wms_quarantine", array_of("wms_quarantine"))
        .when(F.col("loop") == "pos_markdown", array_of("pos_markdown"))
    )
    return actions.select("action_id", "loop", F.explode(chosen).alias("_s")).select("action_id", "loop", "_s.*")


def action_events(actions: DataFrame) -> DataFrame:
    """Feed events of actions, badged with the loop's status."""
    agent = F.lit(None).cast("string")
    for name, loop in LOOP_OF_AGENT.items():
        agent = F.when(F.col("loop") == loop, name).otherwise(agent)
    msg = (
        F.when(F.col("loop") == "equipment_dispatch", F.concat(_text("asset"), F.lit(" maintenance dispatch sent")))
        .when(F.col("loop") == "wms_quarantine", F.concat(F.lit("WMS quarantine applied — "), _text("units_quarantined"),
              F.lit(" units lot #"), _text("lot_number"), F.lit(" isolated")))
        .otherwise(F.concat(F.lit("POS markdown applied — "), _text("product_name"), F.lit(" "), _text("markdown_pct", 0),
                            F.lit("% off · "), scoring.money("revenue_recovered"), F.lit(" revenue recovered")))
    )
    level = F.when(F.col("loop") == "pos_markdown", "HIGH").otherwise("CRITICAL")
    return actions.select(F.col("timestamp").alias("event_ts"), F.col("action_id").alias("seq"), agent.alias("agent"),
                          level.alias("level"), msg.alias("msg"), F.col("status").alias("action_badge"))


def log_entries(actions: DataFrame) -> DataFrame:
    """Action-log entries: a record and a summary for quarantine and markdown, a summary for dispatch. Actions are evaluated once."""
    record_type = F.when(F.col("loop") == "wms_quarantine", "quarantine").when(F.col("loop") == "pos_markdown", "markdown")
    record, summary = (F.lit(n).cast("long") for n in (0, 1))
    places = F.when(F.col("loop") != "equipment_dispatch", F.array(record, summary)).otherwise(F.array(summary))
    rows = actions.withColumn("type", record_type).withColumn("seq", F.explode(places))
    both = ("action_id", "loop", "timestamp", "status", "seq")
    return rows.select(*[
        F.col(f.name) if f.name in both else F.when(F.col("seq") == 0, F.col(f.name)).alias(f.name) for f in schemas.ACTION_LOG.fields])


def dispatch_outbox(dispatches: DataFrame, kind: str = "equipment_critical") -> DataFrame:
    """One notification payload per dispatch; kinds other than ``equipment_critical`` give a text line."""
    asset = F.concat(_text("asset"), F.lit(" — "), _text("zone"))
    anomaly = F.concat(_text("metric"), F.lit(": "), _text("value", 2), F.lit(" vs "), _text("baseline", 2), F.lit(" baseline"))
    rows = dispatches.select(
        "action_id", F.lit(kind).alias("kind"), asset.alias("asset_line"), anomaly.alias("anomaly_line"),
        F.coalesce("recommendation", F.lit(RECOMMENDATION)).alias("recommendation"),
        F.lit(COMPLIANCE_RISK).alias("compliance_line"))
    if kind == "equipment_critical":
        body = F.struct("asset_line", "anomaly_line", "recommendation", "compliance_line")
    else:
        body = F.struct(F.concat(F.lit(f"Alert: {kind} — "), "asset_line", F.lit(" "), "anomaly_line").alias("text"))
    return rows.withColumn("payload", F.to_json(body))


def dispatch_deadlines(readings: DataFrame) -> DataFrame:
    """Breaches with criticality from their anomaly score, the time to act by, and a sort rank."""
    from ..functions.levels import criticality, due_by
    scored = equipment.with_scores(equipment.threshold_breach(readings))
    graded = scored.withColumn("criticality", criticality("anomaly_score"))
    return graded.withColumn("due_by", due_by("criticality", "timestamp")).withColumn(
        "priority", severity_rank("criticality").cast("long"))
