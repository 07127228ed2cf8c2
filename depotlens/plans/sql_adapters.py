"""The adapter formulas of ``adapters`` as SQL common table expressions."""

from __future__ import annotations

import re

_LOT = "'LOT-' || lpad(CAST({n} // 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST({n} % 10000 AS VARCHAR), 4, '0')"


def lot(n: str) -> str:
    return "(" + _LOT.format(n=f"({n})") + ")"


CTES = {
    "readings": """
        SELECT *, CASE WHEN NOT breach THEN 'NOMINAL' WHEN abs(value - threshold) > abs(threshold - baseline)
                       THEN 'CRITICAL' ELSE 'WARNING' END AS status,
               greatest(0e0, least((value - baseline) / (threshold - baseline), 2e0)) / 2e0 AS anomaly_score
        FROM (
          SELECT *, CASE WHEN threshold > baseline THEN value >= threshold ELSE value <= threshold END AS breach
          FROM (
            SELECT event_id AS reading_id, 'SENS-' || user_id AS sensor_id,
                   ['refrigeration', 'amr', 'conveyor', 'dock_door'][CAST(user_id % 4 + 1 AS INTEGER)] AS asset_type,
                   CAST(user_id AS VARCHAR) AS asset_name, 'Z-' || (user_id % 10) AS zone, event_type AS metric, value,
                   50e0 AS baseline, CASE WHEN event_type = 'view' THEN 5e0 ELSE 150e0 END AS threshold, 'ms' AS unit,
                   ts AS "timestamp"
            FROM events))""",
    "compliance": """
        SELECT CAST(event_id AS VARCHAR) AS event_id,
               CASE event_type WHEN 'error' THEN 'temperature_breach' WHEN 'view' THEN 'proximity_event'
                    WHEN 'signup' THEN 'cert_expiry' WHEN 'purchase' THEN 'haccp_audit' ELSE 'recall_match' END AS event_type,
               'Z-' || (user_id % 10) AS zone, CAST(user_id AS VARCHAR) AS asset_id,
               CASE WHEN event_type = 'view' THEN value / 50e0 ELSE value END AS observed_value,
               CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN -10e0 WHEN event_type = 'error' THEN 41e0
                    WHEN event_type = 'view' THEN 1.5e0 WHEN event_type = 'signup' THEN 30e0
                    WHEN event_type = 'purchase' THEN 60e0 ELSE 0e0 END AS threshold_value,
               CASE event_type WHEN 'error' THEN 'degF' WHEN 'view' THEN 'meters' WHEN 'signup' THEN 'days_until_expiry'
                    WHEN 'purchase' THEN 'days' ELSE 'units' END AS unit,
               CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 100 THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM'
                    ELSE 'LOW' END AS severity,
               ['OPEN', 'DOCUMENTED', 'RESOLVED', 'ESCALATED'][CAST(event_id % 4 + 1 AS INTEGER)] AS status,
               '21 CFR 117.93' AS regulation_ref, props AS notes, ts AS "timestamp"
        FROM events""",
    "inventory": """
        SELECT *, spoilage_risk_score > 0.6e0 OR days_to_expiry <= 2 AS markdown_recommended FROM (
          SELECT *, round(least(least(dwell_hours / 96e0, 1e0) * 0.4e0
                                + greatest(0e0, (5e0 - days_to_expiry) / 5e0) * 0.4e0
                                + coalesce(CASE WHEN reorder_point <> 0
                                           THEN greatest(0e0, 1e0 - velocity_7d_avg / reorder_point) END, 0e0) * 0.2e0,
                                1e0), 3) AS spoilage_risk_score
          FROM (
            SELECT 'SKU-' || p_partkey AS sku_id, p_name AS product_name, p_type AS category, p_brand AS zone,
                   p_partkey % 97 + 20 AS qty_on_hand, p_size * 2e0 AS dwell_hours,
                   DATE '2001-05-01' - CAST((p_size * 2) // 24 AS INTEGER) AS received_date,
                   DATE '2001-05-01' + CAST(p_partkey % 12 - 1 AS INTEGER) AS expiry_date, p_partkey % 12 - 1 AS days_to_expiry,
                   'Supplier#' || lpad(CAST(p_partkey % 100 AS VARCHAR), 9, '0') AS vendor,
                   coalesce(short, 0e0) / 90e0 * 7e0 AS velocity_7d_avg, coalesce(long, 0e0) / 360e0 * 7e0 AS velocity_30d_avg,
                   CAST(floor(coalesce(long, 0e0) / 360e0 * 1.5e0 * 7e0) AS BIGINT) AS reorder_point,
                   TIMESTAMP '2001-05-01' AS snapshot_timestamp, p_retailprice AS unit_price
            FROM part LEFT JOIN (
              SELECT l_partkey, sum(CASE WHEN l_shipdate > TIMESTAMP '2001-05-01' - INTERVAL 90 DAY THEN l_quantity END) AS short,
                     sum(l_quantity) AS long
              FROM lineitem
              WHERE l_shipdate > TIMESTAMP '2001-05-01' - INTERVAL 360 DAY AND l_shipdate <= TIMESTAMP '2001-05-01'
              GROUP BY l_partkey) AS sold ON p_partkey = l_partkey))""",
    "daily": """
        SELECT 'SKU-' || l_partkey AS sku_id, CAST(l_shipdate AS DATE) AS sale_date, sum(l_quantity) AS units,
               date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day_num
        FROM lineitem GROUP BY ALL""",
    "docs": f"""
        SELECT *, concat_ws(',', CASE WHEN f_qty THEN 'qty_discrepancy' END, CASE WHEN f_temp THEN 'missing_temp_log' END,
                                 CASE WHEN f_lot THEN 'lot_mismatch' END) AS flags,
               CASE WHEN f_qty THEN 'DISPUTED' WHEN f_temp OR f_lot THEN 'FLAGGED' ELSE 'APPROVED' END AS status,
               f_qty OR f_temp OR f_lot AS flagged
        FROM (
          SELECT *, received_qty - invoiced_qty AS qty_delta, received_qty <> invoiced_qty AS f_qty,
                 cold_chain_req AND NOT temp_log_present AS f_temp, lot_number <> po_lot_number AS f_lot
          FROM (
            SELECT 'BOL-' || l_orderkey || '-' || l_suppkey AS bol_id, l_orderkey AS po_id, any_value(s_name) AS vendor,
                   CAST(min(l_shipdate) AS DATE) AS shipment_date, CAST(max(l_shipdate) AS DATE) AS received_date,
                   min(p_type) AS product_category, min(p_name) AS product_name,
                   CAST(sum(l_quantity) AS BIGINT) AS invoiced_qty,
                   CAST(coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 0e0) AS BIGINT) AS received_qty,
                   0e0 - round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 0e0), 2) AS qty_delta_value,
                   {lot("min(l_partkey)")} AS lot_number, {lot("max(l_partkey)")} AS po_lot_number,
                   bool_and(l_linestatus = 'F') AS temp_log_present, bool_or(p_type IN ('ECONOMY', 'PROMO')) AS cold_chain_req
            FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
            GROUP BY l_orderkey, l_suppkey))""",
    "recalls": f"""
        SELECT 'F-' || p_partkey AS recall_number, CASE WHEN p_size > 45 THEN 'Ongoing' ELSE 'Terminated' END AS status,
               ['Class I', 'Class II', 'Class III'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS classification,
               upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS product,
               'Supplier#' || lpad(CAST(p_partkey % 100 AS VARCHAR), 9, '0') AS vendor,
               'Lots: #' || {lot("p_partkey")} || ', ' || replace({lot("p_partkey + 1")}, 'LOT', 'lot') || '; UPC 123' AS lot_numbers,
               p_type AS quantity, DATE '1998-01-01' + CAST(p_partkey % 365 AS INTEGER) AS recall_date, 'Labelling' AS reason, 'Nationwide' AS distribution,
               CASE WHEN p_size <= 45 THEN '19990101' END AS termination_date
        FROM part""",
    "recall_lots": """
        SELECT DISTINCT recall_number, classification,
               unnest(regexp_extract_all(upper(lot_numbers), '[A-Z]{2,4}-[0-9]{4}(-[0-9]{4})?')) AS lot
        FROM recalls WHERE lower(status) = 'ongoing'""",
    "matched": """
        SELECT d.*, r.recall_number AS matched_recall, r.classification FROM docs d JOIN recall_lots r ON d.lot_number = r.lot""",
    "turns": """
        SELECT *, ['equipment', 'safety', 'forecasting', 'document'][CAST(conv_id % 4 + 1 AS INTEGER)] AS agent
        FROM conversations""",
    "fired": """
        SELECT conv_id || '-' || turn AS request_id, text,
               CASE agent WHEN 'equipment' THEN 'equipment_dispatch' WHEN 'safety' THEN 'wms_quarantine'
                    ELSE 'pos_markdown' END AS loop
        FROM turns
        WHERE role = 'assistant' AND length(text) > 0 AND agent <> 'document'
          AND (contains(lower(text), 'ation') OR contains(lower(text), 'the '))
          AND (agent <> 'forecasting' OR contains(lower(text), 'an'))""",
    "critical_latest": """
        SELECT * FROM readings WHERE status = 'CRITICAL'
        QUALIFY row_number() OVER (PARTITION BY sensor_id, metric ORDER BY "timestamp" DESC, reading_id DESC) = 1""",
    "markdowns": """
        SELECT *, round(unit_price * (1e0 - 30e0 / 100e0), 2) AS new_price, round(unit_price * qty_on_hand, 2) AS revenue_at_risk,
               round(round(unit_price * (1e0 - 30e0 / 100e0), 2) * qty_on_hand, 2) AS revenue_recovered
        FROM inventory WHERE markdown_recommended""",
    "high_risk": """
        SELECT * FROM inventory WHERE spoilage_risk_score > 0.5e0 OR days_to_expiry <= 3 OR dwell_hours > 72""",
    "feed": """
        SELECT "timestamp" AS event_ts, sensor_id || '|' || metric || '|' || epoch_us("timestamp") AS seq, 'equipment' AS agent,
               CASE WHEN status = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS level,
               asset_name || ' ' || metric || ' breached its threshold' AS msg
        FROM readings WHERE breach
        UNION ALL
        SELECT TIMESTAMP '2001-05-01', sku_id, 'forecasting',
               CASE WHEN days_to_expiry < 0 THEN 'CRITICAL' WHEN spoilage_risk_score > 0.6e0 THEN 'HIGH' ELSE 'MEDIUM' END,
               product_name || ': ' || days_to_expiry || ' days to expiry, ' || qty_on_hand || ' units'
        FROM high_risk
        UNION ALL
        SELECT "timestamp", event_id, 'safety', severity, event_type || ' at ' || zone || ' is ' || lower(status)
        FROM compliance WHERE status IN ('OPEN', 'ESCALATED')
        UNION ALL
        SELECT CAST(shipment_date AS TIMESTAMP), bol_id, 'document', CASE WHEN status = 'DISPUTED' THEN 'HIGH' ELSE 'MEDIUM' END,
               bol_id || ' ' || replace(flags, ',', ', ')
        FROM docs WHERE flagged""",
}

# Names in the order a WITH clause must list them.
_ORDER = list(CTES)


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the adapter CTEs it names, directly or through one another."""
    needed: set[str] = set()
    texts = [sql]
    while texts:
        text = texts.pop()
        for name in _ORDER:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                texts.append(CTES[name])
    if not needed:
        return sql.strip()
    body = ",\n".join(f"{name} AS ({CTES[name]})" for name in _ORDER if name in needed)
    stripped = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", stripped):
        return f"WITH RECURSIVE {body},\n{re.sub(r'^WITH RECURSIVE', '', stripped)}"
    if stripped.startswith("WITH "):
        return f"WITH {body},\n{stripped[5:]}"
    return f"WITH {body}\n{stripped}"
