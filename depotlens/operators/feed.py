"""Unified event feed, KPIs, digests and grounding context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.levels import severity_rank
from ..functions.timing import as_ts, days_between
from . import compliance, documents, equipment, inventory, ordered

# JSON output keeps milliseconds only unless told otherwise.
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

FEED_COLUMNS = ["event_ts", "seq", "agent", "level", "msg", "action_badge"]


def _event(ts: Column, seq: Column, agent: str, level: Column, msg: Column) -> list[Column]:
    return [ts.cast("timestamp").alias("event_ts"), seq.cast("string").alias("seq"), F.lit(agent).alias("agent"),
            level.alias("level"), msg.alias("msg"), F.lit(None).cast("string").alias("action_badge")]


def equipment_events(readings: DataFrame) -> DataFrame:
    """Breaching readings as feed events: CRITICAL stays, WARNING shows as HIGH."""
    rows = equipment.threshold_breach(readings)
    level = F.when(F.col("status") == "CRITICAL", "CRITICAL").otherwise("HIGH")
    msg = F.concat_ws(" ", "asset_name", "metric", F.lit("breached its threshold"))
    return rows.select(*_event(F.col("timestamp"), F.concat_ws("|", "sensor_id", "metric", F.unix_micros("timestamp")),
                               "equipment", level, msg))


def inventory_events(stock: DataFrame, as_of=None) -> DataFrame:
    rows = inventory.high_risk_inventory(stock)
    level = F.when(F.col("days_to_expiry") < 0, "CRITICAL").when(F.col("spoilage_risk_score") > 0.6, "HIGH").otherwise("MEDIUM")
    msg = F.concat(F.col("product_name"), F.lit(": "), F.col("days_to_expiry").cast("string"),
                   F.lit(" days to expiry, "), F.col("qty_on_hand").cast("string"), F.lit(" units"))
    return rows.select(*_event(as_ts(as_of), F.col("sku_id"), "forecasting", level, msg))


def compliance_feed(events: DataFrame) -> DataFrame:
    rows = compliance.open_compliance(events)
    msg = F.concat_ws(" ", "event_type", F.lit("at"), "zone", F.lit("is"), F.lower("status"))
    return rows.select(*_event(F.col("timestamp"), F.col("event_id"), "safety", F.col("severity"), msg))


def document_events(docs: DataFrame) -> DataFrame:
    rows = docs.where(F.size("flags") > 0)
    level = F.when(F.col("status") == "QUARANTINED", "CRITICAL").when(F.col("status") == "DISPUTED", "HIGH").otherwise("MEDIUM")
    msg = F.concat(F.col("bol_id"), F.lit(" "), F.array_join("flags", ", "))
    return rows.select(*_event(F.col("shipment_date"), F.col("bol_id"), "document", level, msg))


def unified_feed(readings: DataFrame, stock: DataFrame, events: DataFrame, docs: DataFrame, as_of=None) -> DataFrame:
    """One feed out of the four domains; readers order it with ``feed_order``."""
    parts = [equipment_events(readings), inventory_events(stock, as_of), compliance_feed(events), document_events(docs)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def feed_with_actions(feed: DataFrame, action_events: DataFrame) -> DataFrame:
    return feed.unionByName(action_events.select(*FEED_COLUMNS), allowMissingColumns=True)


def feed_order() -> list[Column]:
    """Newest first; ``seq`` settles equal times."""
    return [F.desc("event_ts"), F.desc("seq")]


def feed_for_agent(feed: DataFrame, agent: str | None = None) -> DataFrame:
    return feed if agent is None else feed.where(F.col("agent") == agent)


def top_event_per_agent(feed: DataFrame) -> DataFrame:
    return ordered.newest_per(feed, ["agent"], ["event_ts", "seq"])


def severity_counts(feed: DataFrame) -> DataFrame:
    return feed.groupBy("level").agg(F.count("*").alias("events"))


def status_digest(feed: DataFrame, per_level: int = 5) -> DataFrame:
    """The newest items of each level across all domains, most severe level first by ``priority``."""
    top = ordered.top_k_per(feed, ["level"], feed_order(), per_level, "rank_in_level")
    return top.withColumn("priority", severity_rank("level").cast("long"))


def _pct(condition: Column) -> Column:
    return F.round(F.try_divide(F.count_if(condition) * 100e0, F.count("*")), 4)


def _long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys…, metric, value) rows out of one aggregate row with a column per metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.metric", "_p.value")


def kpi_summary(readings: DataFrame, stock: DataFrame, events: DataFrame, docs: DataFrame,
                tie: list[str] | None = None) -> DataFrame:
    """Headline KPIs as (metric, value): one aggregate per table.

    ``cold_chain_ok`` and ``cold_chain_total`` count refrigeration assets by their latest readings.
    """
    inv = stock.agg(F.count_distinct("sku_id").alias("active_skus"),
                    F.sum(F.when(inventory.is_high_risk(), F.col("qty_on_hand"))).alias("at_risk_units"))
    cmp_ = events.agg(_pct(~F.col("status").isin("OPEN", "ESCALATED")).alias("compliance_pct"))
    breach = F.coalesce(scoring.is_breach("value", "threshold", "baseline"), F.lit(False))
    eqp = readings.agg(_pct(~breach).alias("fleet_uptime_pct"))
    doc = docs.agg(_pct(F.size("flags") == 0).alias("document_accuracy_pct"))
    cold = equipment.fleet_status(readings.where(F.col("asset_type") == "refrigeration"), tie).agg(
        F.coalesce(F.sum("nominal"), F.lit(0)).alias("cold_chain_ok"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("cold_chain_total"))
    parts = [
        _long(inv, [], ["active_skus", "at_risk_units"]), _long(cmp_, [], ["compliance_pct"]),
        _long(eqp, [], ["fleet_uptime_pct"]), _long(doc, [], ["document_accuracy_pct"]),
        _long(cold, [], ["cold_chain_ok", "cold_chain_total"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def kpi_delta(readings: DataFrame, stock: DataFrame, events: DataFrame, docs: DataFrame,
              tie: list[str] | None = None) -> DataFrame:
    """The KPIs per day with the change against the day before, as (day, metric, value, delta).

    The window runs on one row per (metric, day). Days without data have no row; the change is
    against the last day that has one. Cold chain counts each day's latest readings.
    """
    breach = F.coalesce(scoring.is_breach("value", "threshold", "baseline"), F.lit(False))
    cold = equipment.fleet_status_by_day(readings.where(F.col("asset_type") == "refrigeration"), tie)
    parts = [
        _long(stock.groupBy(F.to_date("snapshot_timestamp").alias("day")).agg(
            F.count_distinct("sku_id").alias("active_skus"),
            F.coalesce(F.sum(F.when(inventory.is_high_risk(), F.col("qty_on_hand"))), F.lit(0)).alias("at_risk_units")),
            ["day"], ["active_skus", "at_risk_units"]),
        _long(events.groupBy(F.to_date("timestamp").alias("day")).agg(
            _pct(~F.col("status").isin("OPEN", "ESCALATED")).alias("compliance_pct")), ["day"], ["compliance_pct"]),
        _long(readings.groupBy(F.to_date("timestamp").alias("day")).agg(
            _pct(~breach).alias("fleet_uptime_pct")), ["day"], ["fleet_uptime_pct"]),
        _long(docs.groupBy(F.col("shipment_date").alias("day")).agg(
            _pct(F.size("flags") == 0).alias("document_accuracy_pct")), ["day"], ["document_accuracy_pct"]),
        _long(cold.select("day", F.col("nominal").alias("cold_chain_ok"), F.col("total").alias("cold_chain_total")),
              ["day"], ["cold_chain_ok", "cold_chain_total"]),
    ]
    daily = reduce(lambda a, b: a.unionByName(b), parts)
    change = F.col("value") - F.lag("value").over(W.partitionBy("metric").orderBy("day"))
    return daily.withColumn("delta", F.round(change, 4))


def telemetry_snapshot(tables: dict[str, DataFrame], kind: str = "all", as_of=None) -> dict[str, DataFrame]:
    """The bounded recent view of each table of a kind; an unknown kind selects none."""
    views = {
        "equipment": lambda df: equipment.recent_equipment(df, as_of),
        "inventory": lambda df: inventory.inventory_at_risk(df),
        "compliance": lambda df: compliance.recent_compliance(df, as_of),
        "documents": lambda df: documents.recent_documents(df, as_of),
    }
    return {name: view(tables[name]) for name, view in views.items() if kind in (name, "all") and name in tables}


def create_views(tables: dict[str, DataFrame]) -> None:
    """Temporary SQL views of high-risk stock, open compliance events and flagged documents."""
    inventory.high_risk_inventory(tables["inventory"]).createOrReplaceTempView("v_high_risk_inventory")
    compliance.open_compliance(tables["compliance"]).createOrReplaceTempView("v_open_compliance")
    documents.flagged_documents(tables["documents"]).createOrReplaceTempView("v_flagged_documents")


def grounding_context(rows: DataFrame, agent: str, order: list[Column], limit: int = 50) -> DataFrame:
    """The first ``limit`` rows as one JSON array for a prompt; an empty array when there are none.

    Only ``limit`` rows reach the single group, whatever the table size.
    """
    top = ordered.top_k(rows, order, limit)
    numbered = top.withColumn("_rank", F.row_number().over(W.orderBy(*order)))
    payload = F.struct(*[F.col(c) for c in rows.columns])
    packed = numbered.agg(F.sort_array(F.collect_list(F.struct(F.col("_rank"), payload.alias("_row")))).alias("_all"))
    body = F.to_json(F.transform("_all", lambda r: r["_row"]), {"timestampFormat": ISO_MICROS})
    return packed.select(F.lit(agent).alias("agent"), F.size("_all").cast("long").alias("n_rows"), body.alias("context"))
