"""Queries over the document log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as rules
from ..functions.levels import document_rank
from ..operators import documents, feed
from ..operators.recalls import apply_quarantine
from .adapters import DOCUMENTS_AS_OF, lot_code
from .registry import query
from .sql_adapters import lot

RECENT_SQL = """
  SELECT bol_id, vendor, shipment_date, invoiced_qty, received_qty, qty_delta, lot_number, po_lot_number, temp_log_present, status, flags
  FROM docs WHERE shipment_date >= DATE '1998-06-30' - 7 AND shipment_date <= DATE '1998-06-30'
  ORDER BY CASE status WHEN 'FLAGGED' THEN 1 WHEN 'DISPUTED' THEN 2 WHEN 'QUARANTINED' THEN 3 WHEN 'PENDING' THEN 4 ELSE 5 END,
           shipment_date DESC, bol_id LIMIT 25"""


@query("recent_documents", f"SELECT * FROM ({RECENT_SQL})")
def recent_documents(i):
    return documents.recent_documents(i.documents_shipped("1998-06-23", DOCUMENTS_AS_OF), DOCUMENTS_AS_OF)


@query("flagged_documents", """
SELECT bol_id, vendor, status, CAST(shipment_date AS TIMESTAMP) AS last_change FROM docs WHERE status IN ('FLAGGED', 'DISPUTED', 'QUARANTINED')""")
def flagged_documents(i):
    return documents.flagged_documents(i.documents).select("bol_id", "vendor", "status", "last_change")


@query("document_flags", """
SELECT bol_id, f_qty AS qty_discrepancy, f_temp AS missing_temp_log, f_lot AS lot_mismatch, flags, status FROM docs""")
def document_flags(i):
    """Flags and status recomputed from raw document fields."""
    raw = i.documents.drop("flags", "status", "qty_delta", "lot_mismatch")
    return documents.with_flags(raw).select(
        "bol_id", *[F.array_contains("flags", f).alias(f) for f in ("qty_discrepancy", "missing_temp_log", "lot_mismatch")],
        "flags", "status")


@query("document_status", """
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN l.lot IS NOT NULL THEN 'QUARANTINED' WHEN received_qty IS NULL THEN
              CASE WHEN f_temp OR f_lot THEN 'FLAGGED' ELSE 'PENDING' END ELSE status END AS status
  FROM (SELECT * REPLACE (nullif(received_qty, 0) AS received_qty) FROM docs) d
  LEFT JOIN (SELECT DISTINCT lot FROM recall_lots) l ON d.lot_number = l.lot) GROUP BY status""")
def document_status(i):
    """Status precedence with recalls applied and nothing-received documents waiting for receipt."""
    waiting = i.documents.withColumn("received_qty", F.when(F.col("received_qty") != 0, F.col("received_qty")))
    marked = apply_quarantine(i.recalls, waiting)
    return documents.with_flags(marked).groupBy("status").agg(F.count("*").alias("n"))


@query("document_rank", """
SELECT status, document_rank, count(*) AS documents FROM (
  SELECT status, CASE status WHEN 'FLAGGED' THEN 1 WHEN 'DISPUTED' THEN 2 WHEN 'QUARANTINED' THEN 3 WHEN 'PENDING' THEN 4 ELSE 5 END::BIGINT AS document_rank
  FROM docs) GROUP BY ALL""")
def rank_documents(i):
    return i.documents.groupBy("status", document_rank("status").alias("document_rank")).agg(F.count("*").alias("documents"))


@query("qty_delta", """
SELECT bol_id, qty_delta, round(qty_delta * 18.75e0, 2) AS value_at_list FROM docs""")
def qty_delta(i):
    return i.documents.select("bol_id", rules.qty_delta().alias("qty_delta"),
                              rules.qty_delta_value(rules.qty_delta(), F.lit(18.75e0)).alias("value_at_list"))


_MATCHES = f"""
  SELECT coalesce(o.po_id, l.po_id) AS po_id, vendor, po_date, o.po_id IS NOT NULL AS has_po, invoiced_qty, received_qty,
         received_qty - invoiced_qty AS qty_delta, lot_number, po_lot_number, received_date,
         CASE WHEN o.po_id IS NULL OR invoiced_qty IS NULL OR received_qty IS NULL THEN 'PENDING'
              WHEN received_qty <> invoiced_qty THEN 'QTY_MISMATCH' WHEN lot_number = po_lot_number THEN 'MATCHED'
              ELSE 'LOT_MISMATCH' END AS match_status
  FROM (SELECT o_orderkey AS po_id, CAST(o_orderdate AS DATE) AS po_date FROM orders) o
  FULL JOIN (
    SELECT coalesce(i.po_id, r.po_id) AS po_id, coalesce(i.vendor, r.vendor) AS vendor, invoiced_qty, received_qty, lot_number,
           po_lot_number, received_date
    FROM (SELECT l_orderkey AS po_id, l_suppkey AS vendor, CAST(sum(l_quantity) AS BIGINT) AS invoiced_qty,
                 string_agg(DISTINCT {lot("l_partkey")}, ',' ORDER BY {lot("l_partkey")}) AS po_lot_number FROM lineitem GROUP BY ALL) i
    FULL JOIN (SELECT l_orderkey AS po_id, l_suppkey AS vendor, CAST(sum(l_quantity) AS BIGINT) AS received_qty,
                      string_agg(DISTINCT {lot("l_partkey")}, ',' ORDER BY {lot("l_partkey")}) AS lot_number, CAST(max(l_shipdate) AS DATE) AS received_date
               FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL) r ON i.po_id = r.po_id AND i.vendor = r.vendor) l
  ON o.po_id = l.po_id"""


def _matches(i):
    """Orders against invoiced lines and against the lines that were kept."""
    line = i.table("lineitem").select(
        F.col("l_orderkey").alias("po_id"), F.col("l_suppkey").alias("vendor"), F.col("l_quantity").cast("long").alias("qty"),
        lot_code(F.col("l_partkey")).alias("lot"), F.to_date("l_shipdate").alias("day"), "l_returnflag")
    orders = i.table("orders").select(F.col("o_orderkey").alias("po_id"), F.to_date("o_orderdate").alias("po_date"))
    invoices = line.select("po_id", "vendor", F.col("qty").alias("invoiced_qty"), F.col("lot").alias("po_lot_number"))
    receipts = line.where(F.col("l_returnflag") != "R").select(
        "po_id", "vendor", F.col("qty").alias("received_qty"), F.col("lot").alias("lot_number"), F.col("day").alias("received_date"))
    return documents.three_way_match(orders, invoices, receipts)


@query("three_way_match", f"SELECT * FROM ({_MATCHES})")
def three_way_match(i):
    return _matches(i)


@query("pending_matches", f"""
SELECT count(*) AS pending, CAST(max(date_diff('day', po_date, DATE '1998-06-30')) AS BIGINT) AS oldest_days
FROM ({_MATCHES}) WHERE invoiced_qty IS NOT NULL AND received_qty IS NULL""")
def pending_matches(i):
    return documents.pending_matches(_matches(i), DOCUMENTS_AS_OF)


@query("vendor_sla", """
SELECT vendor, count(*) AS shipments, count_if(shipment_date <= promised)::BIGINT AS on_time,
       round(count_if(shipment_date <= promised) * 100e0 / count(*), 4) AS on_time_pct,
       round(count_if(shipment_date <= promised) * 100e0 / count(*), 4) < 85 AS breach
FROM (SELECT vendor, shipment_date, CAST(o_orderdate AS DATE) + 30 AS promised FROM docs JOIN orders ON po_id = o_orderkey
      WHERE shipment_date >= DATE '1998-06-30' - 30 AND shipment_date <= DATE '1998-06-30') GROUP BY vendor""")
def vendor_sla(i):
    orders = i.table("orders").select(F.col("o_orderkey").alias("po_id"), F.date_add(F.to_date("o_orderdate"), 30).alias("promised_date"))
    return documents.vendor_sla(i.documents_shipped("1998-05-31", DOCUMENTS_AS_OF).join(orders, "po_id"), DOCUMENTS_AS_OF)


@query("vendor_discrepancies", """
SELECT vendor, count(*) AS documents, count_if(flagged)::BIGINT AS flagged,
       CAST(coalesce(sum(CASE WHEN qty_delta < 0 THEN -qty_delta END), 0) AS BIGINT) AS shortage_units,
       round(coalesce(sum(CASE WHEN qty_delta < 0 THEN -qty_delta_value END), 0e0), 2) AS shortage_value, count_if(flagged) >= 200 AS recurring
FROM docs GROUP BY vendor HAVING count_if(flagged) >= 1""")
def vendor_discrepancies(i):
    return documents.vendor_discrepancies(i.documents, recurring_at=200)


@query("flag_counts", """
SELECT flag, count(*) AS occurrences, count(DISTINCT bol_id) AS documents
FROM (SELECT bol_id, unnest(string_split(flags, ',')) AS flag FROM docs WHERE flagged) GROUP BY flag""")
def flag_counts(i):
    return documents.flag_counts(i.documents)


@query("top_discrepancies", """
SELECT vendor, bol_id, qty_delta, qty_delta_value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY abs(qty_delta_value) DESC, bol_id) AS rank FROM docs WHERE qty_delta <> 0)
WHERE rank <= 3""")
def top_discrepancies(i):
    return documents.top_discrepancies(i.documents)


@query("grounding_documents", f"SELECT 'document' AS agent, bol_id, status FROM ({RECENT_SQL})")
def grounding_documents(i):
    rows = documents.recent_documents(i.documents_shipped("1998-06-23", DOCUMENTS_AS_OF), DOCUMENTS_AS_OF)
    packed = feed.grounding_context(rows, "document", [document_rank("status").asc(), F.desc("shipment_date"), F.asc("bol_id")])
    schema = "array<struct<bol_id: string, status: string>>"
    return packed.select("agent", F.explode(F.from_json("context", schema)).alias("r")).select("agent", "r.*")
