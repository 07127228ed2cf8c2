"""Readers, writers, the action log, recall payloads and row checks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import feed, recalls, validation
from depotlens.plans.actions import Loops
from depotlens.plans.adapters import Inputs
from depotlens.sources import action_log, recall_feed, tables
from depotlens.sources.scratch import new_path

READING = {
    "sensor_id": "S1", "asset_type": "amr", "asset_name": "A", "zone": None, "metric": "m", "value": 3, "baseline": 290,
    "threshold": 2.5, "unit": "cm", "status": "NOMINAL", "anomaly_score": 0.1, "timestamp": "2026-04-30T12:05:03.992355Z",
}


def test_read_array_with_mixed_numbers(spark, tmp_path):
    file = tmp_path / "equipment_readings.json"
    file.write_text(json.dumps([READING, {**READING, "value": 3.25, "baseline": 100.0}]))
    df = tables.read_table(spark, str(file), "equipment_readings")
    rows = df.orderBy("value").select("value", "baseline", F.col("timestamp").cast("string")).collect()
    assert [tuple(r) for r in rows] == [(3.0, 290.0, "2026-04-30 12:05:03.992355"), (3.25, 100.0, "2026-04-30 12:05:03.992355")]


def test_missing_file_is_empty(spark, tmp_path):
    df = tables.read_table(spark, str(tmp_path / "nothing.json"), "inventory_snapshot")
    assert df.count() == 0 and "sku_id" in df.columns
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "nothing.json"), "inventory_snapshot", allow_missing=False)


def test_corrupt_records_are_kept(spark, tmp_path):
    file = tmp_path / "lines.json"
    file.write_text(json.dumps(READING) + "\n{broken\n")
    df = tables.read_table(spark, str(file), "equipment_readings", multi_line=False).cache()
    assert df.where(F.col(tables.CORRUPT).isNotNull()).count() == 1 and df.count() == 2


def test_defaults(spark, tmp_path):
    file = tmp_path / "events.json"
    file.write_text(json.dumps([{"event_id": "E1", "event_type": "haccp_audit"}]))
    assert tables.read_table(spark, str(file), "compliance_events").head().auto_documented is True


def test_bundle_kinds(spark, tmp_path):
    (tmp_path / "equipment_readings.json").write_text(json.dumps([READING]))
    folder = str(tmp_path)
    assert set(tables.telemetry_bundle(spark, folder)) == {"equipment", "inventory", "compliance", "documents"}
    assert list(tables.telemetry_bundle(spark, folder, "equipment")) == ["equipment"]
    assert tables.telemetry_bundle(spark, folder, "weather") == {}
    assert {k: v.count() for k, v in tables.telemetry_bundle(spark, folder).items()} == {
        "equipment": 1, "inventory": 0, "compliance": 0, "documents": 0}


def test_packed_files_hold_the_same_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PACKED_ROWS", 40)
    rows = spark.range(100).select(F.concat(F.lit("S"), "id").alias("sensor_id"), F.lit("temperature").alias("metric"), F.col("id").cast("double").alias("value"),
                                   F.timestamp_seconds(F.col("id") + 0.25).alias("timestamp")).coalesce(1)
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    tables.write_landing(rows, plain)
    tables.write_landing(rows, packed, packed=True)
    files = [f for f in (tmp_path / "packed").iterdir() if f.name.startswith("part-")]
    assert len(files) == 3 and all(f.name.endswith(".json.gz") for f in files)
    assert sum(f.stat().st_size for f in files) * 4 < sum(f.stat().st_size for f in (tmp_path / "plain").iterdir() if f.name.startswith("part-"))
    a, b = (tables.read_table(spark, p, "equipment_readings", multi_line=False) for p in (plain, packed))
    assert a.count() == b.count() == 100 and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_the_bundle_is_landed_packed(spark, small):
    from depotlens.plans.catalog import QUERIES
    landed = []
    land = tables.write_landing
    try:
        tables.write_landing = lambda df, path, **options: (landed.append(path), land(df, path, **options))
        assert QUERIES["telemetry_bundle"](spark, small).count() == 4
    finally:
        tables.write_landing = land
    assert len(landed) == 4 and all(f.endswith(".json.gz") for p in landed for f in spark.read.text(p).inputFiles())


def test_snapshot_and_views(spark, small):
    i = Inputs(spark, small)
    all_tables = {"equipment": i.readings, "inventory": i.inventory, "compliance": i.events, "documents": i.documents}
    shots = feed.telemetry_snapshot(all_tables, "all", "2024-01-15")
    assert set(shots) == set(all_tables) and shots["inventory"].count() == 30
    assert feed.telemetry_snapshot(all_tables, "unknown") == {}
    feed.create_views(all_tables)
    assert spark.sql("SELECT count(*) FROM v_high_risk_inventory").head()[0] == 115
    assert spark.sql("SELECT count(*) FROM v_open_compliance").head()[0] == 500


def test_partitioned_append(spark, small):
    path = new_path(spark, "days")
    readings = Inputs(spark, small).readings
    tables.write_partitioned(readings, path, "timestamp")
    tables.write_partitioned(readings, path, "timestamp")
    assert tables.read_partitioned(spark, path).count() == 2 * readings.count()


def test_action_log_counts(spark, small):
    path = new_path(spark, "log")
    loops = Loops(Inputs(spark, small))
    frames = [loops.dispatches, loops.quarantines, loops.markdowns]
    for frame in frames:
        action_log.append_actions(frame, path)
    counts = [f.count() for f in frames]
    log = action_log.read_actions(spark, path)
    assert log.count() == counts[0] + 2 * counts[1] + 2 * counts[2]
    assert log.columns == [f.name for f in schemas.ACTION_LOG.fields]
    first = log.orderBy(*action_log.log_order()).limit(2).collect()
    assert first[0].action_id == first[1].action_id and [r.seq for r in first] == [0, 1]


def test_recall_payload(spark, tmp_path):
    record = {"recall_number": "F-1", "status": "Ongoing", "product_description": "Lettuce", "recall_initiation_date": "20240105",
              "code_info": "Lot #rlt-2024-0891", "recalling_firm": "V"}
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"results": {"total": 57}}, "results": [record, {"recall_number": "F-2"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"recall_number": "F-3", "recall_initiation_date": "soon"}]}))
    rows = {r.recall_number: r for r in recall_feed.flatten_recalls(recall_feed.read_recall_payloads(spark, str(tmp_path))).collect()}
    assert (rows["F-1"].total, rows["F-2"].total, rows["F-3"].total) == (57, 57, 1)
    assert rows["F-1"].recall_date == dt.date(2024, 1, 5) and rows["F-3"].recall_date is None
    assert rows["F-1"].product == "Lettuce" and rows["F-2"].product is None and len(rows["F-1"]) == 12


def test_lot_match_ignores_hash_and_case(spark):
    recall_rows = spark.createDataFrame(
        [("F-1", "Ongoing", "Class II", "V", "Romaine", "Lot: #RLT-2024-0891 and dl-0441"), ("F-2", "Terminated", "Class I", "V", "Kale", "DL-0442")],
        "recall_number string, status string, classification string, vendor string, product string, lot_numbers string")
    docs = spark.createDataFrame(
        [("B1", "V", "Romaine hearts", "rlt-2024-0891", ["lot_mismatch"], "FLAGGED"), ("B2", "V", "Baby ROMAINE", "DL-9999", None, "APPROVED"),
         ("B3", "W", "Romaine", "#DL-0441", [], "APPROVED"), ("B4", "V", "Kale", "DL-0442", [], "APPROVED"), ("B5", "V", "Kale", None, [], "APPROVED")],
        "bol_id string, vendor string, product_name string, lot_number string, flags array<string>, status string").withColumns(
            {"recall_match": F.lit(False), "recall_number": F.lit(None).cast("string")})
    assert {r.bol_id for r in recalls.affected_documents(recall_rows, docs).collect()} == {"B1", "B3"}
    assert {r.bol_id for r in recalls.unaffected_documents(recall_rows, docs).collect()} == {"B2", "B4", "B5"}
    assert {(r.bol_id, r.candidate_recall) for r in recalls.recall_candidates(recall_rows, docs).collect()} == {("B2", "F-1")}
    after = {r.bol_id: r for r in recalls.apply_quarantine(recall_rows, docs).collect()}
    assert len(after) == 5
    assert (after["B1"].status, after["B1"].flags, after["B1"].recall_number) == ("QUARANTINED", ["recall_match", "lot_mismatch"], "F-1")
    assert (after["B2"].status, after["B2"].flags, after["B2"].recall_match) == ("APPROVED", [], False)


def test_row_checks(spark):
    good = dict(event_id="E1", event_type="haccp_audit", severity="LOW", status="OPEN", timestamp=dt.datetime(2026, 1, 1))
    rows = [good, {**good, "event_id": "E2", "severity": "SEVERE"}, {**good, "event_id": "E3", "status": None}]
    df = spark.createDataFrame([tuple(r[k] for k in good) for r in rows],
                               "event_id string, event_type string, severity string, status string, timestamp timestamp")
    got = {(r.row_key, r.rule, r.column_name, r.found) for r in validation.validate_rows(df, "compliance_events").collect()}
    assert got == {("E2", "domain", "severity", "SEVERE"), ("E3", "required", "status", None)}


def test_empty_tables_flow_through(spark):
    empty = {t: spark.createDataFrame([], s) for t, s in schemas.TABLES.items()}
    kpis = feed.kpi_summary(empty["equipment_readings"], empty["inventory_snapshot"], empty["compliance_events"], empty["document_log"])
    values = {r.metric: r.value for r in kpis.collect()}
    assert values["active_skus"] == 0 and values["compliance_pct"] is None and values["cold_chain_total"] == 0
    row = feed.grounding_context(empty["inventory_snapshot"].select("sku_id"), "forecasting", [F.asc("sku_id")]).head()
    assert (row.n_rows, row.context) == (0, "[]")


def test_shared_folder_comes_from_the_session(spark):
    from depotlens.sources.scratch import shared_dir
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
