"""Document log: recent and flagged views, three-way match, vendor measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents as rules
from ..functions import levels
from ..functions.text import normalise_lot
from ..functions.timing import as_ts, days_between, time_slice
from . import ordered

# Columns of the recent view.
RECENT_COLUMNS = [
    "bol_id", "vendor", "shipment_date", "invoiced_qty", "received_qty", "qty_delta", "lot_number",
    "po_lot_number", "temp_log_present", "status", "flags",
]

SLA_PCT = 85.0  # fixed value


def with_flags(documents: DataFrame) -> DataFrame:
    """Recompute delta, mismatch, flags and status from the document's own fields."""
    return (
        documents.withColumn("qty_delta", rules.qty_delta())
        .withColumn("lot_mismatch", rules.has_lot_mismatch())
        .withColumn("flags", rules.document_flags())
        .withColumn("status", rules.document_status())
    )


def recent_documents(documents: DataFrame, as_of=None, days: int = 7, limit: int = 25) -> DataFrame:
    """Documents shipped in the last week, most urgent status first."""
    rows = time_slice(documents, "shipment_date", as_of, f"{days} days").select(*RECENT_COLUMNS)
    order = [levels.document_rank("status").asc(), F.desc("shipment_date"), F.asc("bol_id")]
    return ordered.top_k(rows, order, limit)


def flagged_documents(documents: DataFrame) -> DataFrame:
    """The exception view with ``last_change``; seeded rows lack update times, shipment date stands in."""
    return (
        documents.where(F.col("status").isin("FLAGGED", "DISPUTED", "QUARANTINED"))
        .withColumn("last_change", F.coalesce("updated_at", F.col("shipment_date").cast("timestamp")))
    )


def three_way_match(orders: DataFrame, invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """Purchase order, invoice and receipt per (order, vendor).

    Inputs: ``orders(po_id, po_date)``, ``invoices(po_id, vendor, invoiced_qty, po_lot_number)`` and
    ``receipts(po_id, vendor, received_qty, lot_number, received_date)``, any number of lines each.
    Invoice and receipt lines are summed before they meet, so line duplicates cannot multiply; a
    side without its counterpart stays as PENDING. Lots match if both sides name the same ones; they
    come as sorted, comma-joined sets, bounded by an order's lines.
    """
    lots = lambda c: F.array_join(F.sort_array(F.collect_set(normalise_lot(c))), ",")
    invoiced = invoices.groupBy("po_id", "vendor").agg(
        F.sum("invoiced_qty").alias("invoiced_qty"), lots("po_lot_number").alias("po_lot_number"))
    received = receipts.groupBy("po_id", "vendor").agg(
        F.sum("received_qty").alias("received_qty"), lots("lot_number").alias("lot_number"),
        F.max("received_date").alias("received_date"))
    lines = invoiced.join(received, ["po_id", "vendor"], "full_outer")
    joined = orders.select("po_id", "po_date").withColumn("has_po", F.lit(True)).join(lines, "po_id", "full_outer")
    has_po = F.coalesce("has_po", F.lit(False))
    complete = has_po & F.col("invoiced_qty").isNotNull() & F.col("received_qty").isNotNull()
    qty_ok = F.col("received_qty") == F.col("invoiced_qty")
    lot_ok = F.col("lot_number") == F.col("po_lot_number")
    status = (
        F.when(~complete, "PENDING").when(~qty_ok, "QTY_MISMATCH")
        .when(~F.coalesce(lot_ok, F.lit(False)), "LOT_MISMATCH").otherwise("MATCHED")
    )
    return joined.select(
        "po_id", "vendor", "po_date", has_po.alias("has_po"), "invoiced_qty", "received_qty",
        rules.qty_delta().alias("qty_delta"), "lot_number", "po_lot_number", "received_date",
        status.alias("match_status"),
    )


def pending_matches(matches: DataFrame, as_of=None) -> DataFrame:
    """Invoices without a receipt: how many, and the age in days of the oldest."""
    waiting = matches.where(F.col("invoiced_qty").isNotNull() & F.col("received_qty").isNull())
    age = days_between(F.to_date(as_ts(as_of)), F.col("po_date"))
    return waiting.agg(F.count("*").alias("pending"), F.max(age).alias("oldest_days"))


def vendor_sla(documents: DataFrame, as_of=None, days: int = 30, sla_pct: float = SLA_PCT) -> DataFrame:
    """On-time share per vendor among documents shipped in the window, against the SLA.

    Documents carry ``promised_date``; one without it is not rated.
    """
    rated = time_slice(documents, "shipment_date", as_of, f"{days} days").where(F.col("promised_date").isNotNull())
    on_time = F.count_if(F.col("shipment_date") <= F.col("promised_date"))
    pct = F.round(on_time * 100e0 / F.count("*"), 4)
    return (
        rated.groupBy("vendor").agg(F.count("*").alias("shipments"), on_time.alias("on_time"), pct.alias("on_time_pct"))
        .withColumn("breach", F.col("on_time_pct") < sla_pct)
    )


def vendor_discrepancies(documents: DataFrame, recurring_at: int = 3, min_flagged: int = 1) -> DataFrame:
    """Per vendor: documents, flagged ones, shortage units and value, and a recurrence flag."""
    flagged = F.count_if(F.size("flags") > 0)
    short = F.col("qty_delta") < 0
    return (
        documents.groupBy("vendor").agg(
            F.count("*").alias("documents"), flagged.alias("flagged"),
            F.coalesce(F.sum(F.when(short, -F.col("qty_delta"))), F.lit(0)).alias("shortage_units"),
            F.round(F.coalesce(F.sum(F.when(short, -F.col("qty_delta_value"))), F.lit(0e0)), 2).alias("shortage_value"),
        )
        .where(F.col("flagged") >= min_flagged)
        .withColumn("recurring", F.col("flagged") >= recurring_at)
    )


def flag_counts(documents: DataFrame) -> DataFrame:
    """How often each flag occurs and on how many documents."""
    return (
        documents.select("bol_id", F.explode("flags").alias("flag")).groupBy("flag")
        .agg(F.count("*").alias("occurrences"), F.count_distinct("bol_id").alias("documents"))
    )


def top_discrepancies(documents: DataFrame, k: int = 3) -> DataFrame:
    """The k largest absolute delta values of each vendor."""
    rows = documents.where(F.col("qty_delta") != 0).select("vendor", "bol_id", "qty_delta", "qty_delta_value")
    return ordered.top_k_per(rows, ["vendor"], [F.abs("qty_delta_value").desc(), F.asc("bol_id")], k)
