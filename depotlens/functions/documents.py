"""Shipping-document flags, status and quantity deltas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise_lot


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_qty_discrepancy() -> Column:
    return F.coalesce(F.col("received_qty") != F.col("invoiced_qty"), F.lit(False))


def has_missing_temp_log() -> Column:
    return F.coalesce(F.col("cold_chain_req") & ~F.coalesce(F.col("temp_log_present"), F.lit(False)), F.lit(False))


def has_lot_mismatch() -> Column:
    return F.coalesce(normalise_lot("lot_number") != normalise_lot("po_lot_number"), F.lit(False))


def document_flags(recall_match="recall_match") -> Column:
    """Array of the rules a document breaks, in priority order; empty when it is clean."""
    flags = F.array(
        F.when(F.coalesce(_c(recall_match), F.lit(False)), "recall_match"),
        F.when(has_qty_discrepancy(), "qty_discrepancy"),
        F.when(has_missing_temp_log(), "missing_temp_log"),
        F.when(has_lot_mismatch(), "lot_mismatch"),
    )
    # Unlike array_compact this stays in generated code.
    return F.array_except(flags, F.array(F.lit(None).cast("string")))


def document_status(flags="flags", received_qty="received_qty") -> Column:
    """Recall first, then dispute, then hold, then waiting for receipt."""
    flags = _c(flags)
    return (
        F.when(F.array_contains(flags, "recall_match"), "QUARANTINED")
        .when(F.array_contains(flags, "qty_discrepancy"), "DISPUTED")
        .when(F.array_contains(flags, "missing_temp_log") | F.array_contains(flags, "lot_mismatch"), "FLAGGED")
        .when(_c(received_qty).isNull(), "PENDING")
        .otherwise("APPROVED")
    )


def qty_delta(received="received_qty", invoiced="invoiced_qty") -> Column:
    """Received minus invoiced: negative is a shortage, positive an overage."""
    return _c(received) - _c(invoiced)


def qty_delta_value(delta="qty_delta", unit_price="unit_price") -> Column:
    return F.round(_c(delta) * _c(unit_price), 2)
