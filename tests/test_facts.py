"""Known results of the executable rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from depotlens.functions import documents as doc_rules
from depotlens.functions import levels, scoring, text, timing
from depotlens.operators import actions, compliance, documents, equipment, inventory
from tests import facts

NOW = "2026-04-30 12:12:03"


@pytest.fixture(scope="module")
def readings(spark):
    rows = [(s, k, a, "Z", m, v, b, t, "ms", "?", 0.0, dt.datetime(2026, 4, 30, 12, 0)) for s, k, a, m, v, b, t, _ in facts.READINGS]
    return spark.createDataFrame(
        rows, "sensor_id string, asset_type string, asset_name string, zone string, metric string, value double, baseline double, "
        "threshold double, unit string, status string, anomaly_score double, timestamp timestamp")


@pytest.fixture(scope="module")
def stock(spark):
    rows = [(s, s, c, "Z", u, d, dt.date(2026, 5, 2), e, "V", v, r) for s, c, d, e, v, r, _, _, u in facts.STOCK]
    raw = spark.createDataFrame(
        rows, "sku_id string, product_name string, category string, zone string, qty_on_hand long, dwell_hours double, expiry_date date, "
        "days_to_expiry long, vendor string, velocity_7d_avg double, reorder_point long")
    scored = inventory.with_spoilage_score(raw)
    return scored.withColumn("markdown_recommended", scoring.is_markdown_candidate("spoilage_risk_score", "days_to_expiry"))


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, k, "Z", a, o, t, u, s, st, "ref", dt.datetime.fromisoformat(ts)) for i, k, a, o, t, u, s, st, ts in facts.EVENTS]
    return spark.createDataFrame(
        rows, "event_id string, event_type string, zone string, asset_id string, observed_value double, threshold_value double, unit string, "
        "severity string, status string, regulation_ref string, timestamp timestamp")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, v, dt.date.fromisoformat(d), n, r, lot, po, log, cold, rec) for i, v, d, n, r, lot, po, log, cold, rec, _, _ in facts.DOCUMENTS]
    raw = spark.createDataFrame(
        rows, "bol_id string, vendor string, shipment_date date, invoiced_qty long, received_qty long, lot_number string, po_lot_number string, "
        "temp_log_present boolean, cold_chain_req boolean, recall_match boolean")
    return documents.with_flags(raw).withColumn("updated_at", F.lit(None).cast("timestamp"))


def test_reading_statuses(readings):
    got = {r.sensor_id: r.status for r in equipment.with_status(readings).collect()}
    assert got == {row[0]: row[-1] for row in facts.READINGS}
    assert {r.sensor_id for r in equipment.threshold_breach(readings).collect()} == set(facts.PCT)


def test_percent_from_baseline(readings):
    got = {r.sensor_id: round(r.pct_from_baseline, 2) for r in equipment.with_scores(readings).collect()}
    assert {k: got[k] for k in facts.PCT} == facts.PCT


def test_spoilage_scores_and_flags(stock):
    got = {r.sku_id: (r.spoilage_risk_score, r.markdown_recommended) for r in stock.collect()}
    assert got == {row[0]: (row[6], row[7]) for row in facts.STOCK}


def test_inventory_views(stock):
    top = [r.sku_id for r in inventory.inventory_at_risk(stock).collect()]
    assert top == ["SKU-4821", "SKU-8801", "SKU-0892", "SKU-1104", "SKU-6601", "SKU-2308"]
    risky = inventory.high_risk_inventory(stock)
    assert {r.sku_id for r in risky.collect()} == {"SKU-4821", "SKU-8801"}
    assert risky.agg(F.sum("qty_on_hand")).head()[0] == 518


def test_compliance_orders(events):
    got = [r.event_id for r in compliance.recent_compliance(events, NOW).collect()]
    assert got == ["EVT-0091", "EVT-0089", "EVT-0088", "EVT-0090", "EVT-0085"]
    assert {r.event_id for r in compliance.open_compliance(events).collect()} == {"EVT-0091", "EVT-0085"}


def test_compliance_direction(events):
    rows = compliance.compliance_direction(events).collect()
    assert all(r.violated for r in rows)
    assert {r.event_id: r.derived_severity for r in rows} == {r[0]: r[6] for r in facts.EVENTS}


def test_recent_compliance_bounds(events):
    # The lower bound is inclusive and rows after as_of do not leak in.
    got = [r.event_id for r in compliance.recent_compliance(events, "2026-04-30 06:12:03", hours=6).collect()]
    assert got == ["EVT-0091", "EVT-0089", "EVT-0085"]
    later = [r.event_id for r in compliance.recent_compliance(events, "2026-04-30 06:12:04", hours=6).collect()]
    assert later == ["EVT-0091", "EVT-0089"]


def test_document_rules_and_orders(docs):
    got = {r.bol_id: (r.flags, r.status) for r in docs.collect()}
    assert got == {row[0]: (row[-2], row[-1]) for row in facts.DOCUMENTS}
    order = [r.bol_id for r in documents.recent_documents(docs, "2026-04-30").collect()]
    assert order == ["BOL-74851", "BOL-74839", "BOL-74821", "BOL-74808"]
    assert documents.flagged_documents(docs).where("last_change = cast(shipment_date as timestamp)").count() == 4


def test_markdown_arithmetic(spark):
    row = spark.range(1).select(
        scoring.markdown_price(F.lit(12.99), F.lit(30)).alias("p"), scoring.revenue(F.lit(12.99), F.lit(340)).alias("risk"),
        scoring.revenue(F.lit(9.09), F.lit(340)).alias("back"), scoring.money(F.lit(3090.6)).alias("m")).head()
    assert (row.p, row.risk, row.back, row.m) == (9.09, 4416.60, 3090.60, "$3,090.60")


def test_spoilage_edges(spark):
    rows = [(10.0, -1, 5.0, 10), (10.0, 5, 5.0, 0), (None, 2, 5.0, 10), (500.0, -5, 0.0, 10), (10.0, 5, None, 10), (96.0, 5, 20.0, 10)]
    df = spark.createDataFrame(rows, "d double, e long, v double, r long")
    got = [x[0] for x in df.select(scoring.spoilage_score("d", "e", "v", "r")).collect()]
    # Expired stock exceeds its 40 %; no reorder point and no velocity give no velocity part; a null dwell gives null; the total caps at 1.
    assert got == [round(10 / 96 * 0.4 + 6 / 5 * 0.4 + 0.1, 3), round(10 / 96 * 0.4, 3), None, 1.0, round(10 / 96 * 0.4, 3), 0.4]


def test_threshold_edges(spark):
    rows = [(320.0, 290.0, 320.0), (95.0, 100.0, 95.0), (351.0, 290.0, 320.0), (350.0, 290.0, 320.0), (89.0, 100.0, 95.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "v double, b double, t double")
    got = [x[0] for x in df.select(scoring.reading_status("v", "t", "b")).collect()]
    assert got == ["WARNING", "WARNING", "CRITICAL", "WARNING", "CRITICAL", "NOMINAL"]
    scores = [x[0] for x in df.select(scoring.anomaly_score("v", "b", "t")).collect()]
    assert scores[0] == 0.5 and scores[-1] is None and 0 <= min(s for s in scores if s is not None)


def test_high_risk_with_null_score(spark):
    df = spark.createDataFrame([("a", None, 80.0, 10), ("b", None, 10.0, 10), ("c", 0.5, 72.0, 4), ("d", None, None, 3)],
                               "sku_id string, spoilage_risk_score double, dwell_hours double, days_to_expiry long")
    assert {r.sku_id for r in inventory.high_risk_inventory(df).collect()} == {"a", "d"}


def test_ranks(spark):
    df = spark.createDataFrame([("CRITICAL",), ("HIGH",), ("MEDIUM",), ("LOW",), (None,)], "s string")
    assert [r[0] for r in df.select(levels.severity_rank("s")).collect()] == [1, 2, 3, 4, 4]
    df = spark.createDataFrame([("FLAGGED",), ("DISPUTED",), ("QUARANTINED",), ("PENDING",), ("APPROVED",), (None,)], "s string")
    assert [r[0] for r in df.select(levels.document_rank("s")).collect()] == [1, 2, 3, 4, 5, 5]


def test_lots_and_excerpt(spark):
    row = spark.range(1).select(
        text.extract_lots(F.lit("lots #rlt-2024-0891, DL-0441 and DL-0441; UPC 123")).alias("lots"),
        text.normalise_lot(F.lit(" #dl-0441 ")).alias("lot"), text.reasoning_excerpt(F.lit("x" * 200)).alias("long"),
        text.reasoning_excerpt(F.lit("short")).alias("short")).head()
    assert row.lots == ["RLT-2024-0891", "DL-0441"] and row.lot == "DL-0441"
    assert row.long == "x" * 180 + "…" and row.short == "short…"


def test_triggers(spark):
    rows = [
        ("equipment", "Hypercritical state", "equipment_dispatch"),  # substring inside a longer word
        ("safety", "we RECALL this", "wms_quarantine"),
        ("forecasting", "salmon spoilage ahead", None),  # no price word
        ("forecasting", "salmon at 30% off", "pos_markdown"),
        ("document", "critical recall price", None),
        ("orchestrator", "critical", None),
        ("equipment", "all fine", None),
    ]
    df = spark.createDataFrame(rows, "agent string, text string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", text.trigger_match("agent", "text")).collect())


def test_iso_times(spark):
    row = spark.range(1).select(timing.parse_iso_utc(F.lit("2026-04-30T12:05:03.992355Z")).cast("string").alias("a"),
                                timing.parse_iso_utc(F.lit("soon")).alias("b")).head()
    assert row.a == "2026-04-30 12:05:03.992355" and row.b is None


def test_overage_is_positive(spark):
    df = spark.createDataFrame([(10, 12), (10, 8)], "invoiced_qty long, received_qty long")
    got = [tuple(r) for r in df.select(doc_rules.qty_delta(), doc_rules.qty_delta_value(doc_rules.qty_delta(), F.lit(2.5))).collect()]
    assert got == [(2, 5.0), (-2, -5.0)]


def test_status_precedence(spark):
    rows = [(["recall_match", "qty_discrepancy"], 1, "QUARANTINED"), (["qty_discrepancy", "lot_mismatch"], 1, "DISPUTED"),
            (["lot_mismatch"], None, "FLAGGED"), ([], None, "PENDING"), ([], 3, "APPROVED")]
    df = spark.createDataFrame(rows, "flags array<string>, received_qty long, want string")
    assert all(r.got == r.want for r in df.withColumn("got", doc_rules.document_status()).collect())


def test_routing_defaults_and_rejects(spark):
    rows = [("1", "pos_markdown", None, "because"), ("2", "wms_quarantine", '{"units": 12}', None),
            ("3", "equipment_dispatch", '{"value": "340ms", "baseline": "290ms"}', None), ("4", "nonsense", "{}", None), ("5", None, None, None)]
    routed, rejects = actions.route_triggers(
        spark.createDataFrame(rows, "request_id string, loop string, data string, agent_response string"), NOW)
    got = {r.loop: r for r in routed.collect()}
    md, qr, eq = got["pos_markdown"], got["wms_quarantine"], got["equipment_dispatch"]
    assert (md.sku_id, md.new_price, md.revenue_at_risk, md.revenue_recovered, md.status) == ("SKU-4821", 9.09, 4416.6, 3090.6, "MARKDOWN APPLIED")
    assert (md.expires_at - md.effective_at) == dt.timedelta(hours=8)
    assert (qr.units_quarantined, qr.bol_id, qr.lot_number, qr.regulation) == (12, "BOL-74808", "RLT-2024-0891", "21 CFR 7.3(m)")
    assert (eq.asset, eq.zone, round(eq.pct_from_baseline, 2)) == ("R-12", "Dairy Zone", 17.24)
    assert {r.request_id: r.reason for r in rejects.collect()} == {"4": "Unknown loop: nonsense", "5": "Unknown loop: null"}
    entries = actions.log_entries(routed).groupBy("loop").count().collect()
    assert {r.loop: r["count"] for r in entries} == {"pos_markdown": 2, "wms_quarantine": 2, "equipment_dispatch": 1}
    assert actions.loop_trace(routed).count() == 12


def test_outbox_kinds(spark, readings):
    rows = actions.equipment_dispatch(readings.withColumn("threshold", F.col("baseline") + 1), NOW).where("metric = 'odometry_drift_cm'")
    alert = actions.dispatch_outbox(rows).orderBy("asset_line").collect()[-1]
    assert alert.asset_line == "AMR-07 — Z" and alert.anomaly_line == "odometry_drift_cm: 3.35 vs 1.00 baseline"
    assert "within 1 hour" in alert.payload and '"recommendation"' in alert.payload
    note = actions.dispatch_outbox(rows, "battery_low").orderBy("asset_line").collect()[-1]
    assert note.payload == '{"text":"Alert: battery_low — AMR-07 — Z odometry_drift_cm: 3.35 vs 1.00 baseline"}'


def test_active_markdown_bounds(spark):
    rows = [("a", "2026-04-30 04:12:03"), ("b", "2026-04-30 04:12:04"), ("c", NOW), ("d", "2026-04-30 12:12:04")]
    df = spark.createDataFrame(rows, "sku_id string, at string").select(
        "sku_id", F.col("at").cast("timestamp").alias("effective_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    assert {r.sku_id for r in actions.active_markdowns(df, NOW).collect()} == {"b", "c"}


def test_recall_page_limit(spark):
    from depotlens.operators.recalls import recall_search
    with pytest.raises(ValueError):
        recall_search(spark.createDataFrame([], "status string, product string, recall_date date, recall_number string"), limit=26)
