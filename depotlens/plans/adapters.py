"""The star-schema test tables seen as warehouse tables.

Operators only know warehouse column names. These adapters derive such tables from the given ones;
``sql_adapters`` states the same formulas in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as doc_rules
from ..functions import scoring
from ..streaming.sources import BYTES_PER_BATCH

INVENTORY_AS_OF = "2001-05-01"
DOCUMENTS_AS_OF = "1998-06-30"

# Event times are read as instants: watermarks need them, and filters reach the Parquet scan uncast.
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

ASSET_TYPES = ["refrigeration", "amr", "conveyor", "dock_door"]
AGENTS = ["equipment", "safety", "forecasting", "document"]

# The conversation texts are invented words, so substitutes stand in for the trigger lists.
CONVERSATION_TRIGGERS = {"equipment": ["ation", "the "], "safety": ["ation", "the "], "forecasting": ["ation", "the "]}
CONVERSATION_PRICE_WORDS = ["an"]


def lot_code(number: Column) -> Column:
    high = F.lpad(F.floor(number / 10000).cast("string"), 4, "0")
    return F.concat(F.lit("LOT-"), high, F.lit("-"), F.lpad((number % 10000).cast("string"), 4, "0"))


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Inputs:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str, bytes_per_slice: int = BYTES_PER_BATCH):
        self.spark, self.folder, self.bytes_per_slice = spark, folder, bytes_per_slice

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw_events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.folder}/events.parquet")

    @cached_property
    def now(self) -> Column:
        """Newest event time as a scalar subquery."""
        return self.raw_events.agg(F.max("ts")).scalar()

    @cached_property
    def readings(self) -> DataFrame:
        return readings_of(self.raw_events)

    @cached_property
    def events(self) -> DataFrame:
        return compliance_of(self.raw_events)

    @cached_property
    def inventory(self) -> DataFrame:
        as_of = F.lit(INVENTORY_AS_OF).cast("timestamp_ntz")
        since = F.expr(f"timestamp_ntz'{INVENTORY_AS_OF}' - interval 360 days")
        recent = F.expr(f"timestamp_ntz'{INVENTORY_AS_OF}' - interval 90 days")
        sold = (
            self.table("lineitem").where((F.col("l_shipdate") > since) & (F.col("l_shipdate") <= as_of))
            .groupBy("l_partkey").agg(
                F.sum(F.when(F.col("l_shipdate") > recent, F.col("l_quantity"))).alias("short"),
                F.sum("l_quantity").alias("long"))
        )
        per_day_short = F.coalesce("short", F.lit(0e0)) / 90e0
        per_day_long = F.coalesce("long", F.lit(0e0)) / 360e0
        day = F.to_date(F.lit(INVENTORY_AS_OF))
        base = self.table("part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").select(
            F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("sku_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"), F.lit(None).cast("string").alias("subcategory"),
            F.col("p_brand").alias("zone"), (F.col("p_partkey") % 97 + 20).alias("qty_on_hand"),
            F.lit("units").alias("unit_of_measure"), (F.col("p_size") * 2e0).alias("dwell_hours"),
            F.date_sub(day, F.floor(F.col("p_size") * 2 / 24).cast("int")).alias("received_date"),
            F.date_add(day, (F.col("p_partkey") % 12 - 1).cast("int")).alias("expiry_date"),
            (F.col("p_partkey") % 12 - 1).alias("days_to_expiry"),
            F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 100).cast("string"), 9, "0")).alias("vendor"),
            (per_day_short * 7e0).alias("velocity_7d_avg"), (per_day_long * 7e0).alias("velocity_30d_avg"),
            F.floor(per_day_long * 1.5e0 * 7e0).cast("long").alias("reorder_point"),
            F.lit(INVENTORY_AS_OF).cast("timestamp").alias("snapshot_timestamp"),
            F.col("p_retailprice").alias("unit_price"),
        )
        score = scoring.spoilage_score("dwell_hours", "days_to_expiry", "velocity_7d_avg", "reorder_point")
        scored = base.withColumn("spoilage_risk_score", score)
        return scored.withColumn(
            "markdown_recommended", scoring.is_markdown_candidate("spoilage_risk_score", "days_to_expiry"))

    @cached_property
    def sales(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat(F.lit("SKU-"), F.col("l_partkey")).alias("sku_id"), F.to_date("l_shipdate").alias("sale_date"),
            F.col("l_quantity").alias("units"))

    @cached_property
    def documents(self) -> DataFrame:
        """One document per (order, supplier); lines are summed first because line numbers repeat."""
        return self._documents(self.table("lineitem"))

    def documents_shipped(self, since: str, until: str) -> DataFrame:
        """The documents with a line shipped between two days (inclusive), among them all first shipped then.

        The dates reach the scan that picks orders, and only their lines are joined and grouped.
        """
        day = F.to_date("l_shipdate")
        first, after = F.lit(since).cast("date"), F.date_add(F.lit(until).cast("date"), 1)
        kind = self.table("lineitem").schema["l_shipdate"].dataType
        shipped = self.table("lineitem").where((F.col("l_shipdate") >= first.cast(kind)) & (F.col("l_shipdate") < after.cast(kind)))
        orders = shipped.where(day.isNotNull()).select("l_orderkey", "l_suppkey")
        return self._documents(self.table("lineitem").join(orders, ["l_orderkey", "l_suppkey"], "left_semi"))

    @cached_property
    def document_rows(self) -> DataFrame:
        """What ``documents`` are made of, before ``document_columns``: narrow rows to move."""
        return self._document_rows(self.table("lineitem"))

    def _documents(self, lineitem: DataFrame) -> DataFrame:
        return document_columns(self._document_rows(lineitem))

    def _document_rows(self, lineitem: DataFrame) -> DataFrame:
        lines = lineitem.join(
            self.table("part").select("p_partkey", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        returned = F.col("l_returnflag") == "R"
        docs = lines.groupBy("l_orderkey", "l_suppkey").agg(
            F.to_date(F.min("l_shipdate")).alias("shipment_date"), F.to_date(F.max("l_shipdate")).alias("received_date"),
            F.min("p_type").alias("product_category"), F.min("p_name").alias("product_name"),
            F.sum("l_quantity").cast("long").alias("invoiced_qty"),
            F.coalesce(F.sum(F.when(~returned, F.col("l_quantity"))), F.lit(0e0)).cast("long").alias("received_qty"),
            (F.lit(0e0) - F.round(F.coalesce(F.sum(F.when(returned, F.col("l_extendedprice"))), F.lit(0e0)), 2)).alias("qty_delta_value"),
            F.min("l_partkey").alias("first_part"), F.max("l_partkey").alias("last_part"),
            F.bool_and(F.col("l_linestatus") == "F").alias("temp_log_present"),
            F.bool_or(F.col("p_type").isin("ECONOMY", "PROMO")).alias("cold_chain_req"),
        )
        named = docs.join(self.table("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        return named.drop("s_suppkey")

    @cached_property
    def recalls(self) -> DataFrame:
        """A recall per part, naming two lots in free text; those of large parts are ongoing."""
        part = self.table("part")
        second = F.regexp_replace(lot_code(F.col("p_partkey") + 1), "LOT", "lot")
        return part.select(
            F.concat(F.lit("F-"), F.col("p_partkey")).alias("recall_number"),
            F.when(F.col("p_size") > 45, "Ongoing").otherwise("Terminated").alias("status"),
            pick(["Class I", "Class II", "Class III"], F.col("p_partkey") % 3).alias("classification"),
            F.initcap(F.element_at(F.split("p_name", " "), 2)).alias("product"), F.lit("Labelling").alias("reason"),
            F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 100).cast("string"), 9, "0")).alias("vendor"),
            F.lit("Nationwide").alias("distribution"),
            F.concat(F.lit("Lots: #"), lot_code(F.col("p_partkey")), F.lit(", "), second, F.lit("; UPC 123")).alias("lot_numbers"),
            F.col("p_type").alias("quantity"),
            F.date_add(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).alias("recall_date"),
            F.when(F.col("p_size") <= 45, "19990101").alias("termination_date"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations").withColumn("agent", pick(AGENTS, F.col("conv_id") % 4))


def document_columns(rows: DataFrame, *more: str) -> DataFrame:
    """Documents from ``document_rows``, with further columns of theirs."""
    named = rows.withColumns({"lot_number": lot_code(F.col("first_part")), "po_lot_number": lot_code(F.col("last_part"))})
    full = named.select(
        F.concat_ws("-", F.lit("BOL"), "l_orderkey", "l_suppkey").alias("bol_id"), F.col("l_orderkey").alias("po_id"),
        F.lit("BOL").alias("doc_type"), F.col("s_name").alias("vendor"), "shipment_date", "received_date",
        "product_category", "product_name", "invoiced_qty", "received_qty", doc_rules.qty_delta().alias("qty_delta"),
        "qty_delta_value", "lot_number", "po_lot_number", doc_rules.has_lot_mismatch().alias("lot_mismatch"),
        "temp_log_present", "cold_chain_req", F.lit(False).alias("recall_match"),
        F.lit(None).cast("string").alias("recall_number"), F.lit(None).cast("timestamp").alias("updated_at"), *more,
    )
    return full.withColumn("flags", doc_rules.document_flags()).withColumn("status", doc_rules.document_status())


def readings_of(events: DataFrame) -> DataFrame:
    """Equipment readings from (batch or streamed) events; ``view`` values are guarded from below."""
    base = events.select(
        F.col("event_id").alias("reading_id"), F.concat(F.lit("SENS-"), F.col("user_id")).alias("sensor_id"),
        pick(ASSET_TYPES, F.col("user_id") % 4).alias("asset_type"), F.col("user_id").cast("string").alias("asset_name"),
        F.concat(F.lit("Z-"), F.col("user_id") % 10).alias("zone"), F.col("event_type").alias("metric"), "value",
        F.lit(50e0).alias("baseline"), F.when(F.col("event_type") == "view", 5e0).otherwise(150e0).alias("threshold"),
        F.lit("ms").alias("unit"), F.col("ts").alias("timestamp"),
    )
    return base.withColumns({
        "status": scoring.reading_status("value", "threshold", "baseline"),
        "anomaly_score": scoring.anomaly_score("value", "baseline", "threshold"),
    })


def compliance_of(events: DataFrame) -> DataFrame:
    """Compliance events from (batch or streamed) events."""
    kind, value = F.col("event_type"), F.col("value")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(kind == "error", "temperature_breach").when(kind == "view", "proximity_event")
        .when(kind == "signup", "cert_expiry").when(kind == "purchase", "haccp_audit").otherwise("recall_match").alias("event_type"),
        F.concat(F.lit("Z-"), F.col("user_id") % 10).alias("zone"), F.col("user_id").cast("string").alias("asset_id"),
        F.when(kind == "view", value / 50e0).otherwise(value).alias("observed_value"),
        F.when((kind == "error") & (F.col("user_id") % 3 == 0), -10e0).when(kind == "error", 41e0).when(kind == "view", 1.5e0)
        .when(kind == "signup", 30e0).when(kind == "purchase", 60e0).otherwise(0e0).alias("threshold_value"),
        F.when(kind == "error", "degF").when(kind == "view", "meters").when(kind == "signup", "days_until_expiry")
        .when(kind == "purchase", "days").otherwise("units").alias("unit"),
        F.when(value >= 150, "CRITICAL").when(value >= 100, "HIGH").when(value >= 50, "MEDIUM").otherwise("LOW").alias("severity"),
        pick(["OPEN", "DOCUMENTED", "RESOLVED", "ESCALATED"], F.col("event_id") % 4).alias("status"),
        F.lit("21 CFR 117.93").alias("regulation_ref"), F.lit(True).alias("auto_documented"), F.col("props").alias("notes"),
        F.lit(None).cast("timestamp").alias("resolved_at"), F.col("ts").alias("timestamp"),
    )
