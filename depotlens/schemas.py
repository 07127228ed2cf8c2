"""Table schemas, required columns and enum domains of the warehouse data model.

Readers apply these schemas explicitly: landing files mix integers and doubles in one JSON
column, so inference would give wrong types. Spark readers do not enforce NOT NULL, so required
columns are listed apart and checked by ``operators.validation``.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


S, D, L, B = StringType(), DoubleType(), LongType(), BooleanType()
DAY, TS = DateType(), TimestampType()

EQUIPMENT_READINGS = _struct(
    sensor_id=S, asset_type=S, asset_name=S, zone=S, metric=S, value=D, baseline=D,
    threshold=D, unit=S, status=S, anomaly_score=D, timestamp=TS,
)

INVENTORY_SNAPSHOT = _struct(
    sku_id=S, product_name=S, category=S, subcategory=S, zone=S, qty_on_hand=L,
    unit_of_measure=S, dwell_hours=D, received_date=DAY, expiry_date=DAY, days_to_expiry=L,
    vendor=S, velocity_7d_avg=D, velocity_30d_avg=D, reorder_point=L, spoilage_risk_score=D,
    markdown_recommended=B, snapshot_timestamp=TS,
)

COMPLIANCE_EVENTS = _struct(
    event_id=S, event_type=S, zone=S, asset_id=S, observed_value=D, threshold_value=D, unit=S,
    severity=S, status=S, regulation_ref=S, auto_documented=B, notes=S, resolved_at=TS,
    timestamp=TS,
)

DOCUMENT_LOG = _struct(
    bol_id=S, doc_type=S, vendor=S, shipment_date=DAY, received_date=DAY, product_category=S,
    product_name=S, invoiced_qty=L, received_qty=L, qty_delta=L, qty_delta_value=D,
    lot_number=S, po_lot_number=S, lot_mismatch=B, temp_log_present=B, cold_chain_req=B,
    status=S, flags=ArrayType(S), recall_match=B, recall_number=S, gcs_uri=S,
    document_ai_job=S, created_at=TS, updated_at=TS,
)

RECALLS = _struct(
    recall_number=S, status=S, classification=S, product=S, reason=S, vendor=S,
    distribution=S, lot_numbers=S, quantity=S, recall_date=DAY, termination_date=S,
)

# Payload of the public food-enforcement feed as landed on disk.
RECALL_PAYLOAD = StructType([
    StructField("meta", StructType([StructField("results", StructType([StructField("total", L)]))])),
    StructField("results", ArrayType(_struct(
        recall_number=S, status=S, classification=S, product_description=S,
        reason_for_recall=S, recalling_firm=S, distribution_pattern=S, code_info=S,
        product_quantity=S, recall_initiation_date=S, termination_date_initiated=S,
    ))),
])

# One wide, nullable, append-only table holds the summary entries of all loops and the
# quarantine and markdown records.
ACTION_LOG = _struct(
    type=S, action_id=S, loop=S, timestamp=TS, status=S, seq=L,
    asset=S, zone=S, metric=S, value=D, baseline=D, pct_from_baseline=D, recommendation=S,
    quarantine_id=S, bol_id=S, lot_number=S, vendor=S, product=S, units_quarantined=L,
    location=S, recall_class=S, recall_number=S, regulation=S, quarantined_by=S,
    quarantined_at=TS,
    markdown_id=S, sku_id=S, product_name=S, original_price=D, markdown_pct=D, new_price=D,
    units_affected=L, spoilage_risk_score=D, days_to_expiry=L, revenue_at_risk=D,
    revenue_recovered=D, markdown_by=S, effective_at=TS, expires_at=TS,
)

FEED_EVENT = _struct(
    event_ts=TS, seq=S, agent=S, level=S, msg=S, action_badge=S,
)

TABLES = {
    "equipment_readings": EQUIPMENT_READINGS,
    "inventory_snapshot": INVENTORY_SNAPSHOT,
    "compliance_events": COMPLIANCE_EVENTS,
    "document_log": DOCUMENT_LOG,
}

# File stem of each table in a landing folder, by the name callers ask for.
BUNDLE = {
    "equipment": "equipment_readings",
    "inventory": "inventory_snapshot",
    "compliance": "compliance_events",
    "documents": "document_log",
}

# Column whose UTC day partitions the stored table.
PARTITION_SOURCE = {
    "equipment_readings": "timestamp",
    "inventory_snapshot": "snapshot_timestamp",
    "compliance_events": "timestamp",
    "document_log": "shipment_date",
}

PRIMARY_KEY = {
    "equipment_readings": "sensor_id",
    "inventory_snapshot": "sku_id",
    "compliance_events": "event_id",
    "document_log": "bol_id",
}

# Columns that must be present. ``created_at`` is left out because seeded
# documents carry none; ordering falls back to ``shipment_date``.
REQUIRED = {
    "equipment_readings": ["sensor_id", "asset_type", "asset_name", "metric", "value", "status", "timestamp"],
    "inventory_snapshot": ["sku_id", "product_name", "qty_on_hand", "snapshot_timestamp"],
    "compliance_events": ["event_id", "event_type", "severity", "status", "timestamp"],
    "document_log": ["bol_id", "doc_type", "vendor", "status"],
}

# Documented enum members. Inventory category is an open string.
DOMAINS = {
    "equipment_readings": {
        "asset_type": ["refrigeration", "amr", "conveyor", "dock_door"],
        "unit": ["ms", "cm", "pct", "degF", "sec"],
        "status": ["NOMINAL", "WARNING", "CRITICAL"],
    },
    "inventory_snapshot": {
        "unit_of_measure": ["units", "cases", "pallets"],
    },
    "compliance_events": {
        "event_type": ["temperature_breach", "proximity_event", "recall_match", "cert_expiry", "haccp_audit"],
        "severity": ["CRITICAL", "HIGH", "MEDIUM", "LOW"],
        "status": ["OPEN", "DOCUMENTED", "RESOLVED", "ESCALATED"],
    },
    "document_log": {
        "doc_type": ["BOL", "INVOICE", "PO", "RECALL_NOTICE"],
        "status": ["APPROVED", "PENDING", "FLAGGED", "DISPUTED", "QUARANTINED"],
    },
}

# Columns documented as lying in [0, 1].
UNIT_INTERVAL = {
    "equipment_readings": ["anomaly_score"],
    "inventory_snapshot": ["spoilage_risk_score"],
    "compliance_events": [],
    "document_log": [],
}

# Column defaults applied on ingest.
DEFAULTS = {
    "compliance_events": {"auto_documented": True},
    "document_log": {"recall_match": False},
}
