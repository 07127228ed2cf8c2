"""Physical plans keep the shapes that scale."""

import pytest

from depotlens.plans.catalog import QUERIES
from depotlens.functions.timing import time_slice
from depotlens.plans.adapters import Inputs
from depotlens.sources import tables
from depotlens.sources.scratch import new_path

# Scoring by matrix product is the only work done in Python.
PYTHON = {"vector_topk", "filtered_vector_topk", "lexical_topk", "hybrid_topk", "retrieved_context", "ivf_topk",
          "lexical_index_topk"}

# These read back what a stream or a writer stored; their work is not in the returned plan.
STORED = {
    "readings_stream", "breach_counts_tumbling", "readings_sliding", "breach_sessions", "dedupe_alerts", "dispatch_cooldown",
    "late_data_audit", "exactly_once_actions", "stream_with_spec", "ack_timeout", "feed_stream", "inventory_stream", "escalations", "write_quarantine",
}


def queries():
    return QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - STORED))
def test_no_cross_joins_and_no_python(spark, small, name):
    text = plan(queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert name in PYTHON or not any(node in text for node in ("MapInArrow", "MapInPandas", "PythonUDF", "FlatMapGroups"))


@pytest.mark.parametrize("name", ["recent_equipment", "inventory_at_risk", "recent_compliance", "recent_documents", "feed_order"])
def test_top_k(spark, small, name):
    assert "TakeOrderedAndProject" in plan(queries()[name](spark, small))


@pytest.mark.parametrize("name", ["status_digest", "top_discrepancies"])
def test_group_limit_before_shuffle(spark, small, name):
    text = plan(queries()[name](spark, small))
    assert text.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["latest_per_sensor", "top_event_per_agent", "certificates_due", "fleet_status", "equipment_dispatch"])
def test_newest_row_is_combined_before_shuffle(spark, small, name):
    text = plan(queries()[name](spark, small))
    assert "partial_max_by" in text and "Window " not in text


def test_newest_row_reads_named_columns_only(spark, small):
    text = plan(queries()["fleet_status"](spark, small))
    assert "props" not in text


def test_day_partitions_are_pruned(spark, small):
    path = new_path(spark, "pruned")
    tables.write_partitioned(Inputs(spark, small).readings, path, "timestamp")
    df = time_slice(tables.read_partitioned(spark, path), "timestamp", "2024-01-20T12:00:00Z", "2 hours")
    text = plan(df)
    filters = text[text.index("PartitionFilters"):text.index("PushedFilters")]
    assert "day" in filters and ">=" in filters
    pushed = text[text.index("PushedFilters"):]
    assert "GreaterThanOrEqual(timestamp" in pushed
    assert df.count() == Inputs(spark, small).readings.where(
        "timestamp between timestamp'2024-01-20 10:00:00' and timestamp'2024-01-20 12:00:00'").count() > 0


def test_columns_and_filters_reach_the_scan(spark, small):
    text = plan(Inputs(spark, small).inventory.select("sku_id", "velocity_7d_avg"))
    assert "GreaterThan(l_shipdate" in text and "l_extendedprice" not in text


def test_stored_score_is_pushed(spark, small):
    path = new_path(spark, "inventory")
    Inputs(spark, small).inventory.write.parquet(path)
    from depotlens.operators.inventory import high_risk_inventory
    text = plan(high_risk_inventory(spark.read.parquet(path)).select("sku_id"))
    assert "GreaterThan(spoilage_risk_score,0.5)" in text


def test_runs_shuffle_rows_once(spark, small):
    # One exchange for the rows and one for the much smaller run pieces.
    assert plan(queries()["breach_episodes"](spark, small)).count("Exchange hashpartitioning") <= 2


def test_vendor_measures_aggregate_before_shuffle(spark, small):
    docs = Inputs(spark, small).documents
    path = new_path(spark, "docs")
    docs.write.parquet(path)
    from depotlens.operators.documents import vendor_discrepancies
    text = plan(vendor_discrepancies(spark.read.parquet(path)))
    assert "partial_count" in text and text.count("Exchange hashpartitioning") == 1


def test_unresolved_search_joins_on_slices(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries()["unresolved_after"](spark, small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(line for line in text.splitlines() if "SortMergeJoin" in line)
    assert "_key" in join and "_slice" in join


@pytest.mark.parametrize("how", ["recall_match", "affected_documents", "unaffected_documents", "apply_quarantine"])
def test_hot_lot_is_split(spark, how):
    """A third of the documents share one lot; AQE must be able to split it in every lot join."""
    from pyspark.sql import functions as F

    from depotlens.operators import recalls
    from depotlens.plans.adapters import lot_code

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {key: spark.conf.get(key) for key in settings}
    docs = spark.range(200_000, numPartitions=8).select(
        F.concat(F.lit("B"), "id").alias("bol_id"), F.md5(F.col("id").cast("string")).alias("product_name"),
        lot_code(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50_000)).alias("lot_number"), F.lit("APPROVED").alias("status"),
        F.array().cast("array<string>").alias("flags"), F.lit(False).alias("recall_match"), F.lit(None).cast("string").alias("recall_number"))
    feed = spark.range(10_000).select(F.concat(F.lit("F"), "id").alias("recall_number"), F.lit("Ongoing").alias("status"),
                                      F.lit("Class I").alias("classification"), lot_code(F.col("id")).alias("lot_numbers"))
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        # Sum whatever the join yields, so that no column of it can be pruned away.
        out = getattr(recalls, how)(feed, docs).agg(F.sum(F.length("product_name")), F.count_if("recall_match"), F.count("recall_number"))
        out.collect()
        assert "SortMergeJoin(skew=true)" in plan(out)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_no_frame_shrinks(spark, small):
    """A frame that ends in unbounded following is summed anew for every row."""
    assert "unboundedfollowing" not in plan(queries()["unresolved_after"](spark, small)).lower()


@pytest.mark.parametrize("name", ["recent_documents", "vendor_sla"])
def test_dates_reach_the_scan_that_picks_orders(spark, small, name):
    text = plan(queries()[name](spark, small))
    assert "LeftSemi" in text
    assert any("l_shipdate" in line and "GreaterThanOrEqual" in line for line in text.splitlines() if "PushedFilters" in line)


def test_ranked_rows_are_evaluated_once(spark, small):
    text = plan(queries()["rank_inventory"](spark, small))
    assert "lineitem" not in text and "part.parquet" not in text
