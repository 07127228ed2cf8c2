"""Spoilage, markdown, baseline and anomaly arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A SKU qualifies above this score, or this close to expiry.
MARKDOWN_SCORE = 0.6
MARKDOWN_DAYS = 2


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def spoilage_score(dwell_hours, days_to_expiry, velocity_7d, reorder_point) -> Column:
    """Weighted risk in three parts: dwell (40 %), expiry (40 %), slow sales (20 %), capped at 1.

    Expired stock pushes the expiry part above its weight; only the total is capped. Without a
    reorder point there is no velocity signal, so that part is 0. Weights and spans (96 hours, 5 days)
    are fixed values. A null dwell or expiry gives a
    null score (``least`` and ``greatest`` would skip it).
    """
    dwell, dte = _c(dwell_hours), _c(days_to_expiry).cast("double")
    ratio = F.try_divide(_c(velocity_7d).cast("double"), _c(reorder_point).cast("double"))
    total = (
        F.least(dwell / 96e0, F.lit(1e0)) * 0.4e0
        + F.greatest(F.lit(0e0), (5e0 - dte) / 5e0) * 0.4e0
        + F.coalesce(F.greatest(F.lit(0e0), F.when(ratio.isNotNull(), 1e0 - ratio)), F.lit(0e0)) * 0.2e0
    )
    score = F.round(F.least(total, F.lit(1e0)), 3)
    return F.when(dwell.isNotNull() & dte.isNotNull(), score)


def is_markdown_candidate(score, days_to_expiry) -> Column:
    return (_c(score) > MARKDOWN_SCORE) | (_c(days_to_expiry) <= MARKDOWN_DAYS)


def markdown_price(price, pct) -> Column:
    return F.round(_c(price) * (F.lit(1e0) - _c(pct) / 100e0), 2)


def revenue(price, units) -> Column:
    """Price times units in cents; gives revenue at risk or, on the new price, recovered."""
    return F.round(_c(price) * _c(units), 2)


def money(amount) -> Column:
    return F.concat(F.lit("$"), F.format_number(_c(amount), 2))


def pct_from_baseline(value, baseline) -> Column:
    value, baseline = _c(value), _c(baseline)
    return F.try_divide(value - baseline, baseline) * 100e0


def is_breach(value, threshold, baseline) -> Column:
    """A reading breaches at or past its threshold, on the side away from the baseline."""
    value, threshold, baseline = _c(value), _c(threshold), _c(baseline)
    return F.when(threshold > baseline, value >= threshold).otherwise(value <= threshold)


def reading_status(value, threshold, baseline) -> Column:
    """NOMINAL, WARNING at the threshold, CRITICAL past it by more than the threshold distance.

    A reading without a threshold cannot breach.
    """
    value, threshold, baseline = _c(value), _c(threshold), _c(baseline)
    over = F.abs(value - threshold) > F.abs(threshold - baseline)
    breach = F.coalesce(is_breach(value, threshold, baseline), F.lit(False))
    return F.when(~breach, "NOMINAL").when(F.coalesce(over, F.lit(False)), "CRITICAL").otherwise("WARNING")


def anomaly_score(value, baseline, threshold) -> Column:
    """Distance from baseline in threshold distances, clipped to [0, 2] and halved: 0.5 at the threshold."""
    value, baseline, threshold = _c(value), _c(baseline), _c(threshold)
    ratio = F.try_divide(value - baseline, threshold - baseline)
    clipped = F.greatest(F.lit(0e0), F.least(ratio, F.lit(2e0))) / 2e0
    return F.when(ratio.isNotNull(), clipped)
