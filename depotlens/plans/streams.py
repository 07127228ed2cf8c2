"""Streaming queries, drained over the event files and read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions, equipment
from ..sources import tables
from ..sources.scratch import materialise, new_path
from ..streaming import alerts, sinks, sources, windows
from .adapters import EVENTS, compliance_of, readings_of
from .equipment import SPEC_SQL, derived_spec
from .registry import query

_CLOSED = """(SELECT max(ts) - INTERVAL 10 MINUTE AS watermark FROM events)"""


def _events(i):
    """The event files as a stream, for queries that treat each row by itself."""
    return sources.table_stream(i.spark, i.folder, "events", EVENTS)


def _drain(i, stream, name):
    path = new_path(i.spark, name)
    return sinks.drain_to_table(stream, f"{path}/table", f"{path}/checkpoint")


def _replay(i, build, name):
    """The stored events replayed in time order through a query that keeps state."""
    slices = sinks.time_slices(i.spark, f"{i.folder}/events.parquet", i.bytes_per_slice)
    return sinks.replay_in_order(i.raw_events, "ts", build, new_path(i.spark, name), slices, bytes_per_slice=i.bytes_per_slice)


@query("readings_stream", 'SELECT sensor_id, metric, value, status, "timestamp" FROM readings')
def readings_stream(i):
    """Readings landed as JSON lines, ingested by the file stream."""
    landed = new_path(i.spark, "landing")
    tables.write_landing(i.readings.drop("reading_id"), landed)
    return _drain(i, sources.readings_stream(i.spark, landed), "readings").select("sensor_id", "metric", "value", "status", "timestamp")


@query("inventory_stream", "SELECT sku_id, zone, qty_on_hand, spoilage_risk_score, days_to_expiry FROM inventory")
def inventory_stream(i):
    """Stock landed as JSON lines, ingested by the file stream."""
    landed = new_path(i.spark, "landing")
    tables.write_landing(i.inventory.drop("unit_price"), landed)
    return _drain(i, sources.inventory_stream(i.spark, landed), "inventory").select(
        "sku_id", "zone", "qty_on_hand", "spoilage_risk_score", "days_to_expiry")


@query("breach_counts_tumbling", f"""
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, metric, count(*) AS readings, count_if(breach)::BIGINT AS breaches
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, "timestamp", TIMESTAMP '1970-01-01') AS window_start FROM readings), {_CLOSED}
WHERE window_start + INTERVAL 5 MINUTE <= watermark GROUP BY window_start, metric""")
def breach_counts_tumbling(i):
    return _replay(i, lambda events: windows.breach_counts_tumbling(readings_of(events())), "tumbling")


@query("readings_sliding", f"""
SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, metric, count(*) AS readings, round(sum(value), 2) AS total,
       max(value) AS max_value
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, "timestamp", TIMESTAMP '1970-01-01') - to_minutes(CAST(k * 15 AS INTEGER)) AS window_start
      FROM readings, (SELECT unnest(range(0, 8)) AS k)), {_CLOSED}
WHERE window_start + INTERVAL 2 HOUR <= watermark GROUP BY window_start, metric""")
def readings_sliding(i):
    """Means of cents sit on rounding ties, so the sum behind the mean is compared."""
    found = _replay(i, lambda events: windows.readings_sliding(readings_of(events())), "sliding")
    return found.withColumn("total", F.round(F.col("mean_value") * F.col("readings"), 2)).drop("mean_value")


@query("breach_sessions", """
WITH breaches AS (
  SELECT *, CASE WHEN "timestamp" < lag("timestamp") OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
  FROM readings WHERE breach WINDOW w AS (PARTITION BY sensor_id ORDER BY "timestamp", reading_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY sensor_id ORDER BY "timestamp", reading_id ROWS UNBOUNDED PRECEDING) AS s FROM breaches),
sessions AS (
  SELECT sensor_id, min("timestamp") AS window_start, max("timestamp") + INTERVAL 6 HOUR AS window_end, count(*) AS breaches, max(value) AS max_value
  FROM numbered GROUP BY sensor_id, s)
SELECT window_start, window_end, sensor_id, breaches, max_value FROM sessions
WHERE window_end <= (SELECT max("timestamp") - INTERVAL 10 MINUTE FROM breaches)""")
def breach_sessions(i):
    return _replay(i, lambda events: windows.breach_sessions(readings_of(events())), "sessions")


@query("dedupe_alerts", 'SELECT reading_id, sensor_id, value, "timestamp" FROM readings WHERE breach')
def dedupe_alerts(i):
    """Every breach delivered twice; one of each survives."""
    def build(events):
        once, again = [
            readings_of(events()).where(F.col("status") != "NOMINAL").select("reading_id", "sensor_id", "value", "timestamp")
            for _ in range(2)]
        return alerts.dedupe_alerts(once.unionByName(again), ["reading_id"])

    return _replay(i, build, "dedupe")


@query("dispatch_cooldown", """
WITH RECURSIVE alert AS (
  SELECT reading_id, sensor_id, "timestamp" AS t FROM readings WHERE value >= 60
  AND "timestamp" < (SELECT date_trunc('milliseconds', max("timestamp")) - INTERVAL 10 MINUTE FROM readings WHERE value >= 60)),
chain AS (
  SELECT sensor_id, min(t) AS t FROM alert GROUP BY sensor_id
  UNION ALL
  SELECT c.sensor_id, min(a.t) AS t FROM chain c JOIN alert a ON a.sensor_id = c.sensor_id AND a.t >= c.t + INTERVAL 8 HOUR
  GROUP BY c.sensor_id)
SELECT a.sensor_id, min(a.reading_id) AS reading_id, a.t AS "timestamp" FROM alert a JOIN chain c ON a.sensor_id = c.sensor_id AND a.t = c.t
GROUP BY a.sensor_id, a.t""")
def dispatch_cooldown(i):
    """Decided up to the watermark; later alerts still wait."""
    return _replay(i, lambda events: alerts.dispatch_cooldown(readings_of(events()).where(F.col("value") >= 60), "reading_id"), "cooldown")


_WAVES = 3


@query("late_data_audit", f"""
WITH waves AS (
  SELECT event_id, ts, least({_WAVES} - 1, ts_third + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS wave FROM (
    SELECT *, CAST(floor((epoch_us(ts) - lo) * {_WAVES}e0 / (hi - lo + 1)) AS BIGINT) AS ts_third
    FROM events, (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events))),
newest AS (SELECT wave, max(ts) AS newest FROM waves GROUP BY wave)
SELECT event_id, ts AS "timestamp", wave AS batch_id FROM waves w
WHERE ts < (SELECT max(newest) - INTERVAL 10 MINUTE FROM newest n WHERE n.wave < w.wave)""")
def late_data_audit(i):
    """Events arrive in three waves by time; errors arrive one wave late. Late rows are kept aside."""
    events = i.raw_events
    span = events.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    low, high = span.select("lo").scalar(), span.select("hi").scalar()
    third = F.floor((F.unix_micros("ts") - low) * float(_WAVES) / (high - low + 1)).cast("long")
    wave = F.least(F.lit(_WAVES - 1), third + F.when(F.col("event_type") == "error", 1).otherwise(0))
    root = new_path(i.spark, "late")
    events.select("event_id", F.col("ts").alias("timestamp"), wave.cast("long").alias("wave")).write.partitionBy(
        "wave").parquet(f"{root}/waves")
    schema = i.spark.read.parquet(f"{root}/waves").drop("wave").schema
    for number in range(_WAVES):
        # Each wave lands in the watched folder before the stream runs again from its checkpoint.
        i.spark.read.schema(schema).parquet(f"{root}/waves/wave={number}").write.mode("append").parquet(f"{root}/landing")
        stream = sources.file_stream(i.spark, f"{root}/landing", schema)
        sinks.drain(stream, sinks.late_data_audit(f"{root}/late", f"{root}/progress"), f"{root}/checkpoint")
    return sinks.read_batches(i.spark, f"{root}/late", schema)


@query("exactly_once_actions", """
SELECT loop, count(*) AS entries FROM (SELECT 'equipment_dispatch' AS loop FROM critical_latest) GROUP BY loop""")
def exactly_once_actions(i):
    """Dispatch entries of a drained stream, every batch of which is delivered twice and must not add rows.

    A batch keeps its newest critical breach per sensor and metric; the newest of all is picked when they are read.
    """
    root = new_path(i.spark, "actions")
    columns = ["reading_id", "sensor_id", "metric", "asset_name", "zone", "value", "baseline", "threshold", "timestamp"]

    def newest(batch):
        critical = equipment.threshold_breach(batch).where(F.col("status") == "CRITICAL")
        return equipment.latest_per_sensor(critical, ["reading_id"], columns)

    write = sinks.exactly_once(f"{root}/breaches", newest)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    readings = readings_of(_events(i))
    sinks.drain(readings, twice, f"{root}/checkpoint")
    kept = sinks.read_batches(i.spark, f"{root}/breaches", readings.select(*columns).schema)
    entries = actions.log_entries(actions.equipment_dispatch(kept, "2024-02-01", ["reading_id"]))
    return entries.groupBy("loop").agg(F.count("*").alias("entries"))


@query("stream_with_spec", f"""
SELECT reading_id, metric, value, threshold FROM ({SPEC_SQL}) WHERE value >= threshold""")
def stream_with_spec(i):
    # Written once, or every micro-batch would measure it again.
    spec = materialise(derived_spec(i.readings), "spec")
    joined = alerts.stream_with_spec(readings_of(_events(i)), spec)
    return _drain(i, joined.select("reading_id", "metric", "value", "threshold"), "with-spec")


@query("ack_timeout", """
SELECT reading_id, sensor_id, "timestamp" FROM readings d
WHERE metric = 'error' AND "timestamp" + INTERVAL 61 MINUTE < (
  SELECT min(newest) - INTERVAL 10 MINUTE FROM (SELECT max("timestamp") AS newest FROM readings WHERE metric IN ('error', 'signup') GROUP BY metric))
AND NOT EXISTS (
  SELECT 1 FROM readings a WHERE a.metric = 'signup' AND a.sensor_id = d.sensor_id AND a."timestamp" >= d."timestamp"
  AND a."timestamp" <= d."timestamp" + INTERVAL 1 HOUR)""")
def ack_timeout(i):
    """Errors without a signup of the same sensor within the hour."""
    def build(events):
        sent = readings_of(events()).where(F.col("metric") == "error").select("reading_id", "sensor_id", "timestamp")
        acks = readings_of(events()).where(F.col("metric") == "signup").select("sensor_id", "timestamp")
        return alerts.ack_timeout(sent, acks)

    return _replay(i, build, "ack")


@query("escalations", """
SELECT event_id, asset_id, "timestamp", 'ESCALATED' AS status FROM compliance b, (
  SELECT date_trunc('milliseconds', max("timestamp")) - INTERVAL 10 MINUTE AS watermark FROM compliance
  WHERE status = 'RESOLVED' OR event_type = 'temperature_breach')
WHERE event_type = 'temperature_breach' AND status <> 'RESOLVED' AND b."timestamp" + INTERVAL 1 HOUR < watermark AND NOT EXISTS (
  SELECT 1 FROM compliance r WHERE r.asset_id = b.asset_id AND r.status = 'RESOLVED'
  AND r."timestamp" >= b."timestamp" AND r."timestamp" <= b."timestamp" + INTERVAL 1 HOUR)""")
def escalations(i):
    """Unresolved breaches as their hour passes."""
    found = _replay(i, lambda events: alerts.escalations(compliance_of(events())), "escalations")
    return found.select("event_id", "asset_id", "timestamp", "status")


@query("feed_stream", """
SELECT event_ts, seq, agent, level, msg FROM feed WHERE agent IN ('equipment', 'safety')""")
def feed_stream(i):
    return _drain(i, alerts.feed_stream(readings_of(_events(i)), compliance_of(_events(i))).drop("action_badge"), "feed")
