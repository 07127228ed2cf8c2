"""Inventory risk, velocity, markdown candidates and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.timing import as_ts
from ..sources.scratch import materialise
from . import ordered

# Columns of the at-risk view, and the strict limits of both risk views below.
AT_RISK_COLUMNS = [
    "sku_id", "product_name", "category", "zone", "qty_on_hand", "dwell_hours", "expiry_date", "vendor",
    "velocity_7d_avg", "reorder_point", "spoilage_risk_score", "markdown_recommended",
]

# Storage zone by category; every other category is General.
ZONE_OF_CATEGORY = {
    "produce": "Produce",
    "dairy": "Dairy Cold",
    "meat_seafood": "Meat & Seafood",
    "bakery": "Bakery",
    "deli": "Deli",
    "beverage": "Beverage",
}


def is_at_risk() -> Column:
    return (F.col("spoilage_risk_score") > 0.3) | (F.col("dwell_hours") > 48)


def is_high_risk() -> Column:
    return (F.col("spoilage_risk_score") > 0.5) | (F.col("days_to_expiry") <= 3) | (F.col("dwell_hours") > 72)


def inventory_at_risk(inventory: DataFrame, limit: int = 30) -> DataFrame:
    rows = inventory.where(is_at_risk()).select(*AT_RISK_COLUMNS)
    return ordered.top_k(rows, [F.desc("spoilage_risk_score"), F.asc("sku_id")], limit)


def high_risk_inventory(inventory: DataFrame) -> DataFrame:
    """The high-risk view. Row order belongs to the reader, so the view does not sort."""
    return inventory.where(is_high_risk())


def markdown_candidates(inventory: DataFrame) -> DataFrame:
    return inventory.where(scoring.is_markdown_candidate("spoilage_risk_score", "days_to_expiry"))


def with_spoilage_score(inventory: DataFrame) -> DataFrame:
    score = scoring.spoilage_score("dwell_hours", "days_to_expiry", "velocity_7d_avg", "reorder_point")
    return inventory.withColumn("spoilage_risk_score", score)


def enrich_inventory(items: DataFrame, as_of=None) -> DataFrame:
    """Derive dates, reorder point, zone, score and markdown flag from raw stock rows.

    Needs ``dwell_hours``, ``days_to_expiry``, ``base_velocity``, ``velocity_7d_avg`` and ``category``.
    """
    today = F.to_date(as_ts(as_of))
    zone = F.lit("General")
    for category, name in ZONE_OF_CATEGORY.items():
        zone = F.when(F.col("category") == category, name).otherwise(zone)
    dated = items.withColumns({
        "expiry_date": F.date_add(today, F.col("days_to_expiry").cast("int")),
        "received_date": F.date_sub(today, (F.col("dwell_hours") / 24).cast("int")),
        "reorder_point": (F.col("base_velocity") * 1.5e0).cast("long"),
        "zone": zone,
    })
    return with_spoilage_score(dated).withColumn(
        "markdown_recommended", scoring.is_markdown_candidate("spoilage_risk_score", "days_to_expiry"))


def rank_inventory(inventory: DataFrame, score: str = "spoilage_risk_score", key: str = "sku_id") -> DataFrame:
    """Whole-table rank by score, highest first: row number, dense rank and percent rank.

    A global window would pull the table into one task. Rows are numbered by a distributed running
    count instead; tied scores are resolved from a per-score table.
    """
    one = F.lit(1).cast("long")
    # Written once: the range sample, the range write and the score table would each evaluate it again.
    inventory = materialise(inventory, "ranked-rows")
    numbered = ordered.prefix_sums(inventory, [F.desc_nulls_last(score), F.asc(key)], {"_before": one}, "rank")
    scores = inventory.groupBy(F.col(score).alias("_score")).agg(F.count("*").alias("_n"))
    # Rounded scores make this table short; it is numbered the same way in case they are not.
    levels = ordered.prefix_sums(scores, [F.desc_nulls_last("_score")], {"_above": F.col("_n"), "_level": one},
                                 "rank-levels")
    total = inventory.agg(F.count("*").alias("_total")).scalar()
    ranks = levels.select(
        "_score", (F.col("_level") + 1).alias("dense_rank"),
        F.coalesce(F.try_divide(F.col("_above").cast("double"), total - 1), F.lit(0e0)).alias("percent_rank"),
    )
    return (
        numbered.withColumn("row_num", F.col("_before") + 1).drop("_before")
        .join(ranks, F.col(score).eqNullSafe(F.col("_score")), "left").drop("_score")
    )


def daily_units(sales: DataFrame) -> DataFrame:
    """Units per (sku, day) with the day as a number since 1970-01-01."""
    daily = sales.groupBy("sku_id", "sale_date").agg(F.sum("units").alias("units"))
    return daily.withColumn("day_num", F.unix_date("sale_date"))


def rolling_velocity(daily: DataFrame, days: int = 7) -> DataFrame:
    """Mean daily units over the trailing ``days`` days; days without sales count as 0.

    Runs on daily totals, so a SKU's window holds at most one row per day.
    """
    trailing = W.partitionBy("sku_id").orderBy("day_num").rangeBetween(-(days - 1), 0)
    return daily.withColumn(f"velocity_{days}d_avg", F.sum("units").over(trailing) / F.lit(float(days)))


def velocity_uplift(daily: DataFrame, days: int = 7) -> DataFrame:
    """Today's units against the mean of the ``days`` days before, in percent."""
    before = W.partitionBy("sku_id").orderBy("day_num").rangeBetween(-days, -1)
    base = F.coalesce(F.sum("units").over(before), F.lit(0)) / F.lit(float(days))
    return (
        daily.withColumn("trailing_avg", base)
        .withColumn("uplift_pct", F.try_divide(F.col("units") - F.col("trailing_avg"), F.col("trailing_avg")) * 100e0)
    )


def _stock_measures() -> list[Column]:
    return [
        F.count("*").alias("skus"),
        F.count_if(F.col("dwell_hours") > 72).alias("skus_over_72h"),
        F.sum("qty_on_hand").alias("units"),
        F.max("spoilage_risk_score").alias("max_score"),
    ]


def zone_rollup(inventory: DataFrame) -> DataFrame:
    """Zone by category, zone and grand totals; ``level`` tells subtotals from null keys."""
    return inventory.rollup("zone", "category").agg(F.grouping_id().cast("long").alias("level"), *_stock_measures())


def zone_cube(inventory: DataFrame) -> DataFrame:
    """All combinations of zone and category subtotals."""
    return inventory.cube("zone", "category").agg(F.grouping_id().cast("long").alias("level"), *_stock_measures())
