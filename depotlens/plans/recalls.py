"""Queries over recalls, documents and stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import extract_lots
from ..operators import feed, recalls
from ..sources import recall_feed
from ..sources.scratch import new_path, release
from .adapters import document_columns
from .registry import query


@query("flatten_recalls", """
SELECT recall_number, status, classification, product, reason, vendor, distribution, lot_numbers, quantity, recall_date, termination_date,
       count(*) OVER (PARTITION BY vendor) AS total FROM recalls""")
def flatten_recalls(i):
    """Recalls landed as feed payloads, pages of one vendor with its total, and flattened again."""
    fields = [
        (F.date_format(column, "yyyyMMdd") if column == "recall_date" else F.col(column)).alias(name)
        for column, name in recall_feed.FIELD_OF_COLUMN.items()]
    # Numbers of one vendor are 100 apart, so a page of 2,500 numbers holds MAX_RECALL_PAGE recalls of each vendor at most.
    page = F.floor(F.substring_index("recall_number", "-", -1).cast("long") / (100 * recalls.MAX_RECALL_PAGE))
    pages = i.recalls.groupBy("vendor", page.alias("page")).agg(F.collect_list(F.struct(*fields)).alias("results"))
    totals = i.recalls.groupBy("vendor").agg(F.count("*").alias("total"))
    payloads = pages.join(totals, "vendor").select(
        F.struct(F.struct("total").alias("results")).alias("meta"), "results")
    path = new_path(i.spark, "recall-feed")
    payloads.write.json(path)
    return recall_feed.flatten_recalls(recall_feed.read_recall_payloads(i.spark, path, multi_line=False)).select(
        "recall_number", "status", "classification", "product", "reason", "vendor", "distribution", "lot_numbers", "quantity",
        "recall_date", "termination_date", "total")


_SEARCH = "FROM recalls WHERE lower(status) = 'ongoing' ORDER BY recall_date DESC, recall_number LIMIT 10"


@query("recall_search", f"SELECT recall_number, product, recall_date {_SEARCH}")
def recall_search(i):
    return recalls.recall_search(i.recalls).select("recall_number", "product", "recall_date")


@query("recall_search_by_product", """
SELECT recall_number, product, recall_date FROM recalls WHERE lower(status) = 'terminated' AND contains(lower(product), 'in')
ORDER BY recall_date DESC, recall_number LIMIT 25""")
def recall_search_by_product(i):
    return recalls.recall_search(i.recalls, "IN", 25, "Terminated").select("recall_number", "product", "recall_date")


@query("extract_lots", """
SELECT recall_number, unnest(regexp_extract_all(upper(lot_numbers), '[A-Z]{2,4}-[0-9]{4}(-[0-9]{4})?')) AS lot FROM recalls""")
def extract_lots_query(i):
    return i.recalls.select("recall_number", F.explode(extract_lots("lot_numbers")).alias("lot"))


@query("recall_match", "SELECT bol_id, lot_number, vendor, matched_recall, classification FROM matched")
def recall_match(i):
    return recalls.recall_match(i.recalls, i.documents).select("bol_id", "lot_number", "vendor", "matched_recall", "classification")


@query("affected_documents", "SELECT bol_id, lot_number, vendor FROM docs WHERE lot_number IN (SELECT lot FROM recall_lots)")
def affected_documents(i):
    return recalls.affected_documents(i.recalls, i.documents).select("bol_id", "lot_number", "vendor")


@query("unaffected_documents", "SELECT bol_id, lot_number, vendor FROM docs WHERE lot_number NOT IN (SELECT lot FROM recall_lots)")
def unaffected_documents(i):
    return recalls.unaffected_documents(i.recalls, i.documents).select("bol_id", "lot_number", "vendor")


@query("recall_candidates", """
SELECT bol_id, d.vendor, product_name, r.recall_number AS candidate_recall FROM docs d JOIN recalls r ON d.vendor = r.vendor
AND lower(r.status) = 'ongoing' AND contains(lower(d.product_name), lower(r.product))
WHERE NOT EXISTS (SELECT 1 FROM recall_lots l WHERE l.recall_number = r.recall_number AND l.lot = d.lot_number)""")
def recall_candidates(i):
    return recalls.recall_candidates(i.recalls, i.documents).select("bol_id", "vendor", "product_name", "candidate_recall")


@query("apply_quarantine", """
SELECT bol_id, CASE WHEN lot IS NOT NULL THEN 'QUARANTINED' ELSE status END AS status,
       CASE WHEN lot IS NULL THEN flags WHEN flags = '' THEN 'recall_match' ELSE 'recall_match,' || flags END AS flags,
       lot IS NOT NULL AS recall_match, recall_number
FROM docs LEFT JOIN (SELECT lot, min(recall_number) AS recall_number FROM recall_lots GROUP BY lot) ON lot_number = lot""")
def apply_quarantine(i):
    return recalls.apply_quarantine(i.recalls, i.documents).select("bol_id", "status", "flags", "recall_match", "recall_number")


@query("write_quarantine", f"""
SELECT bol_id, CASE WHEN lot IS NOT NULL THEN 'QUARANTINED' ELSE status END AS status,
       CASE WHEN lot IS NULL THEN flags WHEN flags = '' THEN 'recall_match' ELSE 'recall_match,' || flags END AS flags,
       lot IS NOT NULL AS recall_match, recall_number
FROM docs LEFT JOIN (SELECT lot, min(recall_number) AS recall_number FROM recall_lots GROUP BY lot) ON lot_number = lot""")
def write_quarantine(i):
    """The stored log, in folders by month, after those with hits were replaced, and read back."""
    path = new_path(i.spark, "document-log")
    # The narrow rows move to their month; the wide ones are made of them there.
    monthly = i.document_rows.withColumn("month", F.trunc("received_date", "month")).hint("rebalance", F.col("month"))
    document_columns(monthly, "month").write.partitionBy("month").parquet(path)
    release(i.spark)
    recalls.write_quarantine(i.recalls, path, part="month")
    return i.spark.read.parquet(path).select("bol_id", "status", "flags", "recall_match", "recall_number")


@query("alert_with_recalled_stock", """
SELECT vendor, product_name, skus, units_at_risk, recalled_documents
FROM (SELECT vendor, product_name, count(*) AS skus, sum(qty_on_hand)::BIGINT AS units_at_risk FROM inventory GROUP BY ALL)
JOIN (SELECT vendor, product_name, count(*) AS recalled_documents FROM docs
      WHERE lot_number IN (SELECT lot FROM recall_lots) GROUP BY ALL) USING (vendor, product_name)""")
def alert_with_recalled_stock(i):
    return recalls.alert_with_recalled_stock(i.recalls, i.documents, i.inventory)


@query("grounding_recalls", f"SELECT 'safety' AS agent, recall_number, lot_numbers {_SEARCH}")
def grounding_recalls(i):
    rows = recalls.recall_search(i.recalls).select("recall_number", "product", "lot_numbers", "recall_date")
    packed = feed.grounding_context(rows, "safety", [F.desc("recall_date"), F.asc("recall_number")])
    schema = "array<struct<recall_number: string, lot_numbers: string>>"
    return packed.select("agent", F.explode(F.from_json("context", schema)).alias("r")).select("agent", "r.*")
