"""Severity and status ranks, criticality windows and compliance direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank orders of the two priority lists; anything else sorts after them.
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM"]
DOCUMENT_ORDER = ["FLAGGED", "DISPUTED", "QUARANTINED", "PENDING"]

# Hours to act per criticality; LOW is logged only.
RESPONSE_HOURS = {"CRITICAL": 1, "HIGH": 4, "MEDIUM": 48}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _rank(column: Column, order: list[str]) -> Column:
    expr = F.when(column == order[0], 1)
    for position, value in enumerate(order[1:], 2):
        expr = expr.when(column == value, position)
    return expr.otherwise(len(order) + 1)


def severity_rank(column) -> Column:
    return _rank(_c(column), SEVERITY_ORDER)


def document_rank(column) -> Column:
    return _rank(_c(column), DOCUMENT_ORDER)


def criticality(score) -> Column:
    """Criticality from an anomaly score: 0.5 is the threshold, 1.0 twice the threshold distance."""
    score = _c(score)
    return (
        F.when(score >= 1.0, "CRITICAL").when(score >= 0.75, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")
    )


def due_by(level, ts) -> Column:
    """Deadline for a criticality level; null for LOW."""
    level, ts = _c(level), _c(ts)
    expr = None
    for name, hours in RESPONSE_HOURS.items():
        value = ts + F.expr(f"interval {hours} hours")
        expr = F.when(level == name, value) if expr is None else expr.when(level == name, value)
    return expr


def breach_direction(event_type, unit, threshold) -> Column:
    """``above`` or ``below``: the side of the threshold on which an event is a violation.

    Days left and distances violate from below, whatever the event; other events go by their type.
    """
    event_type, unit, threshold = _c(event_type), F.lower(_c(unit)), _c(threshold)
    return (
        F.when((event_type == "temperature_breach") & (threshold < 0), "below")
        .when(event_type == "temperature_breach", "above")
        .when(event_type.isin("proximity_event", "cert_expiry") | unit.isin("days_until_expiry", "meters"), "below")
        .when(event_type.isin("recall_match", "haccp_audit"), "above")
    )


def is_violation(observed, threshold, direction) -> Column:
    observed, threshold, direction = _c(observed), _c(threshold), _c(direction)
    return F.when(direction == "above", observed > threshold).when(direction == "below", observed < threshold)


def overshoot(observed, threshold, direction) -> Column:
    """Distance past the threshold on the violating side; 0 when within limits."""
    observed, threshold, direction = _c(observed), _c(threshold), _c(direction)
    gap = F.when(direction == "above", observed - threshold).when(direction == "below", threshold - observed)
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0e0)))


def compliance_severity(event_type, observed, threshold) -> Column:
    """Severity from event type and overshoot.

    A recall match is CRITICAL, heat above a chill limit is HIGH, cold below a freezer limit and
    proximity are MEDIUM. Certificates, audits and whatever is inside its limit are LOW.
    """
    event_type, observed, threshold = _c(event_type), _c(observed), _c(threshold)
    direction = breach_direction(event_type, F.lit(None).cast("string"), threshold)
    violated = F.coalesce(is_violation(observed, threshold, direction), F.lit(False))
    return (
        F.when(~violated, "LOW")
        .when(event_type == "recall_match", "CRITICAL")
        .when((event_type == "temperature_breach") & (threshold >= 0), "HIGH")
        .when(event_type.isin("temperature_breach", "proximity_event"), "MEDIUM")
        .otherwise("LOW")
    )
