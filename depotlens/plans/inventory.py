"""Queries over the inventory snapshot and daily sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timing
from ..operators import feed, inventory
from .adapters import INVENTORY_AS_OF
from .registry import query


@query("inventory_at_risk", """
SELECT sku_id, product_name, category, zone, qty_on_hand, dwell_hours, expiry_date, vendor,
       round(velocity_7d_avg, 6) AS velocity_7d_avg, reorder_point, spoilage_risk_score, markdown_recommended
FROM inventory WHERE spoilage_risk_score > 0.3e0 OR dwell_hours > 48
ORDER BY spoilage_risk_score DESC NULLS LAST, sku_id LIMIT 30""")
def inventory_at_risk(i):
    return inventory.inventory_at_risk(i.inventory)


@query("high_risk_inventory", """
SELECT sku_id, category, zone, qty_on_hand, dwell_hours, days_to_expiry, spoilage_risk_score FROM high_risk""")
def high_risk_inventory(i):
    return inventory.high_risk_inventory(i.inventory).select(
        "sku_id", "category", "zone", "qty_on_hand", "dwell_hours", "days_to_expiry", "spoilage_risk_score")


@query("markdown_candidates", """
SELECT sku_id, days_to_expiry, spoilage_risk_score FROM inventory WHERE spoilage_risk_score > 0.6e0 OR days_to_expiry <= 2""")
def markdown_candidates(i):
    return inventory.markdown_candidates(i.inventory).select("sku_id", "days_to_expiry", "spoilage_risk_score")


@query("spoilage_score", """
SELECT sku_id, spoilage_risk_score FROM inventory""")
def spoilage_score(i):
    return inventory.with_spoilage_score(i.inventory.drop("spoilage_risk_score")).select("sku_id", "spoilage_risk_score")


@query("enrich_inventory", """
SELECT sku_id, DATE '2001-05-01' + CAST(days_to_expiry AS INTEGER) AS expiry_date,
       DATE '2001-05-01' - CAST(trunc(dwell_hours / 24) AS INTEGER) AS received_date,
       CAST(trunc(velocity_30d_avg * 1.5e0) AS BIGINT) AS reorder_point,
       CASE category WHEN 'PROMO' THEN 'Produce' WHEN 'SMALL' THEN 'Dairy Cold' ELSE 'General' END AS zone
FROM inventory""")
def enrich_inventory(i):
    """Raw stock rows with two known categories; the rest falls to the general zone."""
    category = F.when(F.col("category") == "PROMO", "produce").when(F.col("category") == "SMALL", "dairy").otherwise(F.col("category"))
    raw = i.inventory.drop("expiry_date", "received_date", "reorder_point", "zone").withColumns({
        "base_velocity": F.col("velocity_30d_avg"), "category": category})
    return inventory.enrich_inventory(raw, INVENTORY_AS_OF).select(
        "sku_id", "expiry_date", "received_date", "reorder_point", "zone")


@query("days_to_expiry", """
SELECT sku_id, CAST(date_diff('day', DATE '2001-05-01', expiry_date) AS BIGINT) AS days_left FROM inventory""")
def days_to_expiry(i):
    return i.inventory.select("sku_id", timing.days_to_expiry("expiry_date", INVENTORY_AS_OF).alias("days_left"))


@query("dwell_hours", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, (epoch(TIMESTAMP '2002-01-01') - epoch(l_shipdate)) / 3600e0 AS dwell_hours FROM lineitem""")
def dwell_hours(i):
    return i.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                      timing.dwell_hours("l_shipdate", "2002-01-01").alias("dwell_hours"))


def _velocity(days):
    return f"""
SELECT sku_id, sale_date, units, round(sum(units) OVER (PARTITION BY sku_id ORDER BY day_num
       RANGE BETWEEN {days - 1} PRECEDING AND CURRENT ROW) / {days}e0, 6) AS velocity_{days}d_avg FROM daily"""


@query("rolling_velocity_7d", _velocity(7))
def rolling_velocity_7d(i):
    return inventory.rolling_velocity(inventory.daily_units(i.sales), 7).drop("day_num")


@query("rolling_velocity_30d", _velocity(30))
def rolling_velocity_30d(i):
    return inventory.rolling_velocity(inventory.daily_units(i.sales), 30).drop("day_num")


@query("velocity_uplift", """
SELECT sku_id, sale_date, units, round(a, 6) AS trailing_avg, round((units - a) / nullif(a, 0) * 100e0, 6) AS uplift_pct
FROM (SELECT *, coalesce(sum(units) OVER (PARTITION BY sku_id ORDER BY day_num RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0e0) / 7e0 AS a
      FROM daily)""")
def velocity_uplift(i):
    return inventory.velocity_uplift(inventory.daily_units(i.sales), 7).drop("day_num")


@query("rank_inventory", """
SELECT sku_id, spoilage_risk_score, row_number() OVER (ORDER BY spoilage_risk_score DESC NULLS LAST, sku_id) AS row_num,
       dense_rank() OVER (ORDER BY spoilage_risk_score DESC NULLS LAST) AS dense_rank,
       round(percent_rank() OVER (ORDER BY spoilage_risk_score DESC NULLS LAST), 6) AS percent_rank FROM inventory""")
def rank_inventory(i):
    return inventory.rank_inventory(i.inventory.select("sku_id", "spoilage_risk_score"))


_STOCK = """CAST(grouping(zone, category) AS BIGINT) AS level, count(*) AS skus, count_if(dwell_hours > 72)::BIGINT AS skus_over_72h,
       sum(qty_on_hand)::BIGINT AS units, max(spoilage_risk_score) AS max_score FROM inventory"""


@query("zone_rollup", f"SELECT zone, category, {_STOCK} GROUP BY ROLLUP (zone, category)")
def zone_rollup(i):
    return inventory.zone_rollup(i.inventory)


@query("zone_cube", f"SELECT zone, category, {_STOCK} GROUP BY CUBE (zone, category)")
def zone_cube(i):
    return inventory.zone_cube(i.inventory)


@query("grounding_inventory", """
SELECT 'forecasting' AS agent, sku_id, spoilage_risk_score FROM (
  SELECT sku_id, spoilage_risk_score FROM inventory WHERE spoilage_risk_score > 0.3e0 OR dwell_hours > 48
  ORDER BY spoilage_risk_score DESC NULLS LAST, sku_id LIMIT 30)""")
def grounding_inventory(i):
    rows = inventory.inventory_at_risk(i.inventory)
    packed = feed.grounding_context(rows, "forecasting", [F.desc("spoilage_risk_score"), F.asc("sku_id")])
    schema = "array<struct<sku_id: string, spoilage_risk_score: double>>"
    return packed.select("agent", F.explode(F.from_json("context", schema)).alias("r")).select("agent", "r.*")
