"""Queries over equipment readings, and the table reader and writer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions, equipment, feed, validation
from ..sources import tables
from ..sources.scratch import new_path
from .registry import query

TIE = ["reading_id"]


@query("recent_equipment", """
SELECT sensor_id, asset_name, zone, metric, value, baseline, threshold, unit, status,
       round(anomaly_score, 6) AS anomaly_score, "timestamp"
FROM readings, (SELECT max(ts) AS now FROM events)
WHERE "timestamp" >= now - INTERVAL 2 HOUR AND "timestamp" <= now
ORDER BY anomaly_score DESC NULLS LAST, "timestamp" DESC, sensor_id, metric LIMIT 50""")
def recent_equipment(i):
    return equipment.recent_equipment(i.readings, i.now)


@query("threshold_breach", """
SELECT reading_id, sensor_id, metric, value, threshold, status, "timestamp" FROM readings WHERE breach""")
def threshold_breach(i):
    return equipment.threshold_breach(i.readings).select(
        "reading_id", "sensor_id", "metric", "value", "threshold", "status", "timestamp")


@query("latest_per_sensor", """
SELECT sensor_id, metric, reading_id, value, "timestamp" FROM readings
QUALIFY row_number() OVER (PARTITION BY sensor_id, metric ORDER BY "timestamp" DESC, reading_id DESC) = 1""")
def latest_per_sensor(i):
    return equipment.latest_per_sensor(i.readings, TIE, ["sensor_id", "metric", "reading_id", "value", "timestamp"])


SPEC_SQL = """
WITH spec AS (SELECT asset_type, metric, round(avg(value), 1) AS baseline, round(avg(value), 1) + 100e0 AS threshold
              FROM readings WHERE metric <> 'signup' GROUP BY asset_type, metric)
SELECT r.reading_id, r.asset_type, r.metric, r.value, s.baseline, s.threshold
FROM readings r LEFT JOIN spec s ON r.asset_type = s.asset_type AND r.metric = s.metric"""


def derived_spec(readings):
    """A specification dimension measured from the readings; one metric has none."""
    mean = F.round(F.avg("value"), 1)
    return readings.where(F.col("metric") != "signup").groupBy("asset_type", "metric").agg(
        mean.alias("baseline"), (mean + 100e0).alias("threshold"))


@query("readings_with_spec", SPEC_SQL)
def readings_with_spec(i):
    return equipment.readings_with_spec(i.readings, derived_spec(i.readings)).select(
        "reading_id", "asset_type", "metric", "value", "baseline", "threshold")


@query("pct_from_baseline", """
SELECT reading_id, round((value - baseline) / baseline * 100e0, 6) AS pct_from_baseline FROM readings""")
def pct_from_baseline(i):
    return equipment.with_scores(i.readings).select("reading_id", "pct_from_baseline")


@query("anomaly_score", """
SELECT reading_id, round(anomaly_score, 6) AS anomaly_score FROM readings""")
def anomaly_score(i):
    return equipment.with_scores(i.readings).select("reading_id", "anomaly_score")


@query("rolling_zscore", """
SELECT reading_id, sensor_id, before, round((value - m) / nullif(s, 0), 4) + 0e0 AS zscore
FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, round(sum(value) OVER w, 2) AS before FROM readings
      WINDOW w AS (PARTITION BY sensor_id ORDER BY "timestamp", reading_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))""")
def rolling_zscore(i):
    """Z-score, and the sum behind it: means of cents sit on rounding ties, sums do not."""
    scored = equipment.rolling_zscore(i.readings, TIE)
    before = F.round(F.col("rolling_mean") * F.col("rolling_count"), 2)
    return scored.select("reading_id", "sensor_id", before.alias("before"), F.round("zscore", 4).alias("zscore"))


@query("breach_episodes", """
WITH marked AS (
  SELECT *, CASE WHEN breach = lag(breach) OVER w THEN 0 ELSE 1 END AS changed FROM readings
  WINDOW w AS (PARTITION BY sensor_id, metric ORDER BY "timestamp", reading_id)),
islands AS (
  SELECT *, sum(changed) OVER (PARTITION BY sensor_id, metric ORDER BY "timestamp", reading_id
                               ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT sensor_id, metric, min("timestamp") AS started_at, max("timestamp") AS ended_at, count(*) AS n_readings,
       round((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 60e6, 6) AS minutes,
       CASE WHEN any_value(threshold > baseline) THEN max(value) ELSE min(value) END AS worst_value
FROM islands WHERE breach GROUP BY sensor_id, metric, island""")
def breach_episodes(i):
    return equipment.breach_episodes(i.readings, TIE)


@query("fleet_status", """
WITH latest AS (
  SELECT * FROM readings
  QUALIFY row_number() OVER (PARTITION BY sensor_id, metric ORDER BY "timestamp" DESC, reading_id DESC) = 1),
assets AS (
  SELECT asset_type, asset_name, max(CASE status WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS lvl
  FROM latest GROUP BY asset_type, asset_name)
SELECT asset_type, count(*) AS total, count_if(lvl = 0)::BIGINT AS nominal, count_if(lvl = 1)::BIGINT AS warning,
       count_if(lvl = 2)::BIGINT AS critical FROM assets GROUP BY asset_type""")
def fleet_status(i):
    return equipment.fleet_status(i.readings, TIE)


@query("sensor_profile", """
SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM readings GROUP BY metric""")
def sensor_profile(i):
    return equipment.sensor_profile(i.readings)


@query("sensor_profile_approx", """
SELECT metric, count(value) AS n, true AS sensors_close, true AS p50_close, true AS p95_close FROM readings GROUP BY metric""")
def sensor_profile_approx(i):
    """Are the estimates inside their stated errors? Distinct counts: 3 standard errors of 5 %; percentiles: 1/10,000 of the ranks."""
    near = equipment.sensor_profile_approx(i.readings)
    sensors = i.readings.groupBy("metric").agg(F.count_distinct("sensor_id").alias("sensors"))
    joined = i.readings.join(near, "metric").groupBy("metric", "n", "sensors_approx").agg(*[
        count.alias(f"{side}_{p}") for p in ("p50", "p95") for side, count in (
            ("below", F.count_if(F.col("value") < F.col(f"{p}_approx"))), ("upto", F.count_if(F.col("value") <= F.col(f"{p}_approx"))))])

    def close(p, q):
        slack = F.col("n") / 10_000 + 1
        return (F.col(f"below_{p}") <= q * F.col("n") + slack) & (F.col(f"upto_{p}") >= q * F.col("n") - slack)

    return joined.join(sensors, "metric").select(
        "metric", "n", (F.abs(F.col("sensors_approx") - F.col("sensors")) <= 0.15 * F.col("sensors")).alias("sensors_close"),
        close("p50", 0.5).alias("p50_close"), close("p95", 0.95).alias("p95_close"))


@query("criticality", """
SELECT reading_id, criticality, due_by, CASE criticality WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3
       ELSE 4 END::BIGINT AS priority
FROM (SELECT *, CASE criticality WHEN 'CRITICAL' THEN "timestamp" + INTERVAL 1 HOUR WHEN 'HIGH' THEN "timestamp" + INTERVAL 4 HOUR
                     WHEN 'MEDIUM' THEN "timestamp" + INTERVAL 48 HOUR END AS due_by
      FROM (SELECT *, CASE WHEN anomaly_score >= 1 THEN 'CRITICAL' WHEN anomaly_score >= 0.75 THEN 'HIGH'
                           WHEN anomaly_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS criticality
            FROM readings WHERE breach))""")
def criticality(i):
    return actions.dispatch_deadlines(i.readings).select("reading_id", "criticality", "due_by", "priority")


@query("validate_rows", """
SELECT 'equipment_readings' AS table_name, rule, column_name, count(*) AS violations FROM (
  SELECT 'domain' AS rule, 'unit' AS column_name FROM (SELECT CASE WHEN metric = 'view' THEN 'volt' ELSE unit END AS u FROM readings)
  WHERE u NOT IN ('ms', 'cm', 'pct', 'degF', 'sec')
  UNION ALL SELECT 'required', 'value' FROM readings WHERE value > 400
  UNION ALL SELECT 'unit_interval', 'anomaly_score' FROM readings WHERE value / 100e0 > 1
) GROUP BY rule, column_name""")
def validate_rows(i):
    """Readings with a foreign unit, dropped large values and unscaled scores; counts per broken rule."""
    dirty = i.readings.withColumns({
        "unit": F.when(F.col("metric") == "view", "volt").otherwise(F.col("unit")),
        "anomaly_score": F.col("value") / 100e0,
        "value": F.when(F.col("value") <= 400, F.col("value")),
    })
    return validation.validate_rows(dirty, "equipment_readings").groupBy("table_name", "rule", "column_name").agg(
        F.count("*").alias("violations"))


@query("write_partitioned", """
SELECT CAST("timestamp" AS DATE) AS day, count(*) AS readings, round(sum(value), 2) AS total FROM readings GROUP BY day""")
def write_partitioned(i):
    path = new_path(i.spark, "readings-by-day")
    tables.write_partitioned(i.readings, path, "timestamp")
    return tables.read_partitioned(i.spark, path).groupBy("day").agg(
        F.count("*").alias("readings"), F.round(F.sum("value"), 2).alias("total"))


@query("read_table", """
SELECT sensor_id, metric, value, baseline, threshold, status, "timestamp" FROM readings""")
def read_table(i):
    """Readings landed as JSON lines and read back under the declared schema."""
    path = new_path(i.spark, "landed")
    tables.write_landing(i.readings.drop("reading_id"), path, packed=True)
    return tables.read_table(i.spark, path, "equipment_readings", multi_line=False).select(
        "sensor_id", "metric", "value", "baseline", "threshold", "status", "timestamp")


@query("telemetry_bundle", """
SELECT 'equipment' AS name, count(*) AS n FROM readings UNION ALL SELECT 'inventory', count(*) FROM inventory
UNION ALL SELECT 'compliance', count(*) FROM compliance UNION ALL SELECT 'documents', count(*) FROM docs""")
def telemetry_bundle(i):
    """Row counts of the four tables landed as JSON lines."""
    path = new_path(i.spark, "bundle")
    for table, df in (("equipment_readings", i.readings), ("inventory_snapshot", i.inventory),
                      ("compliance_events", i.events), ("document_log", i.documents)):
        tables.write_landing(df, f"{path}/{table}", packed=True)
    bundle = tables.telemetry_bundle(i.spark, path, "all", suffix="", multi_line=False)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in bundle.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query("grounding_equipment", """
WITH top AS (
  SELECT sensor_id, asset_name, zone, metric, value, baseline, threshold, unit, status, anomaly_score, "timestamp"
  FROM readings, (SELECT max(ts) AS now FROM events)
  WHERE "timestamp" >= now - INTERVAL 2 HOUR AND "timestamp" <= now
  ORDER BY anomaly_score DESC NULLS LAST, "timestamp" DESC, sensor_id, metric LIMIT 50)
SELECT 'equipment' AS agent, sensor_id, metric, value, "timestamp" FROM top""")
def grounding_equipment(i):
    """The packed context, unpacked again to comparable rows."""
    rows = equipment.recent_equipment(i.readings, i.now)
    order = [F.desc("anomaly_score"), F.desc("timestamp"), F.asc("sensor_id"), F.asc("metric")]
    packed = feed.grounding_context(rows, "equipment", order)
    schema = "array<struct<sensor_id: string, metric: string, value: double, timestamp: timestamp>>"
    return packed.select("agent", F.explode(F.from_json("context", schema)).alias("r")).select("agent", "r.*")
