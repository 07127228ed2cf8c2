"""Hand-written rows with known results.

Values mirror published facts about the data model: four sensors out of limits, stock scores, event
and document orders.
"""

READINGS = [
    # sensor, asset type, asset, metric, value, baseline, threshold, expected status
    ("SENS-A", "refrigeration", "R-12", "compressor_cycle_ms", 342.8, 290.0, 320.0, "WARNING"),
    ("SENS-B", "refrigeration", "R-03", "door_seal_integrity_pct", 90.1, 100.0, 95.0, "WARNING"),
    ("SENS-C", "amr", "AMR-07", "odometry_drift_cm", 3.35, 1.0, 2.5, "WARNING"),
    ("SENS-D", "amr", "AMR-11", "battery_capacity_pct", 70.6, 94.0, 80.0, "WARNING"),
    ("SENS-E", "refrigeration", "R-01", "compressor_cycle_ms", 289.4, 290.0, 320.0, "NOMINAL"),
    ("SENS-F", "amr", "AMR-03", "odometry_drift_cm", 1.2, 1.0, 2.5, "NOMINAL"),
]

PCT = {"SENS-A": 18.21, "SENS-B": -9.9, "SENS-C": 235.0, "SENS-D": -24.89}

STOCK = [
    # sku, category, dwell, days to expiry, 7-day velocity, reorder point, expected score, expected markdown flag, units
    ("SKU-4821", "meat_seafood", 57.1, 2, 186.7, 270, 0.54, True, 351),
    ("SKU-8801", "produce", 41.6, 2, 356.7, 442, 0.452, True, 167),
    ("SKU-0892", "deli", 71.8, 6, 81.2, 142, 0.385, False, 555),
    ("SKU-1104", "produce", 39.1, 4, 402.7, 630, 0.315, False, 318),
    ("SKU-6601", "bakery", 57.9, 8, 350.5, 510, 0.304, False, 115),
    ("SKU-2308", "deli", 63.6, 6, 182.3, 217, 0.297, False, 562),
    ("SKU-7703", "dairy", 44.5, 16, 484.9, 765, 0.259, False, 591),
    ("SKU-3412", "dairy", 38.5, 5, 287.1, 330, 0.186, False, 355),
    ("SKU-1205", "meat_seafood", 33.6, 9, 521.5, 570, 0.157, False, 53),
    ("SKU-5620", "produce", 15.0, 10, 556.5, 720, 0.108, False, 50),
]

EVENTS = [
    # id, type, asset, observed, threshold, unit, severity, status, time
    ("EVT-0091", "recall_match", "DOCK", 340.0, 0.0, "units", "CRITICAL", "OPEN", "2026-04-30 06:12:03"),
    ("EVT-0089", "temperature_breach", "R-08", 42.0, 41.0, "degF", "HIGH", "DOCUMENTED", "2026-04-30 04:26:03"),
    ("EVT-0090", "temperature_breach", "R-22", -14.0, -10.0, "degF", "MEDIUM", "DOCUMENTED", "2026-04-30 06:59:03"),
    ("EVT-0088", "proximity_event", "AMR-03", 1.2, 1.5, "meters", "MEDIUM", "DOCUMENTED", "2026-04-30 10:50:03"),
    ("EVT-0085", "cert_expiry", "EMP-0441", 14.0, 30.0, "days_until_expiry", "LOW", "OPEN", "2026-04-30 00:12:03"),
]

DOCUMENTS = [
    # id, vendor, shipped, invoiced, received, lot, PO lot, temperature log, cold chain, recall, expected flags, expected status
    ("BOL-74808", "Vendor A", "2026-04-28", 340, 340, "RLT-2024-0891", "RLT-2024-0891", True, True, True, ["recall_match"], "QUARANTINED"),
    ("BOL-74821", "Vendor B", "2026-04-28", 480, 462, "DMT-2024-1102", "DMT-2024-1102", True, False, False, ["qty_discrepancy"], "DISPUTED"),
    ("BOL-74839", "Vendor C", "2026-04-29", 220, 220, "TYS-2024-0891", "TYS-2024-0891", False, True, False, ["missing_temp_log"], "FLAGGED"),
    ("BOL-74851", "Vendor D", "2026-04-30", 180, 180, "DL-0442", "DL-0441", False, False, False, ["lot_mismatch"], "FLAGGED"),
]
