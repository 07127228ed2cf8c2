"""Streams over several files against their batch counterparts."""

import datetime as dt

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.operators import actions, equipment
from depotlens.plans import streams
from depotlens.plans.adapters import EVENTS, Inputs, readings_of
from depotlens.sources.scratch import new_path
from depotlens.streaming import alerts, sinks, sources, windows


@pytest.fixture(scope="module")
def landed(spark, small):
    """The events in time order over five files, each its own micro-batch."""
    path = new_path(spark, "landed")
    events = Inputs(spark, small).raw_events
    fifth = F.ntile(5).over(W.orderBy("ts"))
    for n in range(1, 6):
        events.withColumn("n", fifth).where(F.col("n") == n).drop("n").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, landed):
    return readings_of(sources.file_stream(spark, landed, EVENTS, files_per_batch=1))


def drained(spark, df, name):
    path = new_path(spark, name)
    return sinks.drain_to_table(df, f"{path}/t", f"{path}/c")


def same(left, right):
    columns = sorted(left.columns)
    return sorted(map(str, left.select(columns).collect())) == sorted(map(str, right.select(columns).collect()))


@pytest.fixture(scope="module")
def batch(spark, small):
    return Inputs(spark, small).readings


def closed(batch, column="window_end", delay="10 minutes"):
    newest = batch.agg(F.max("timestamp")).head()[0]
    return F.col(column) <= F.lit(newest) - F.expr(f"interval {delay}")


def test_tumbling(spark, landed, batch):
    got = drained(spark, windows.breach_counts_tumbling(stream(spark, landed)), "t")
    want = windows.breach_counts_tumbling(batch).where(closed(batch))
    assert same(got, want) and got.count() > 0


def test_sliding(spark, landed, batch):
    got = drained(spark, windows.readings_sliding(stream(spark, landed)), "s").withColumn("mean_value", F.round("mean_value", 9))
    want = windows.readings_sliding(batch).where(closed(batch)).withColumn("mean_value", F.round("mean_value", 9))
    assert same(got, want)


def test_sessions(spark, landed, batch):
    got = drained(spark, windows.breach_sessions(stream(spark, landed)), "e")
    want = windows.breach_sessions(batch).where(closed(equipment.threshold_breach(batch)))
    assert same(got, want) and got.count() > 0


def greedy(rows, hours):
    last, kept = {}, set()
    for key, at, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or at >= last[key] + dt.timedelta(hours=hours):
            last[key] = at
            kept.add(n)
    return kept


@pytest.mark.parametrize("hours", [0.5, 8, 1000])
def test_cooldown_across_batches(spark, landed, batch, hours):
    got = drained(spark, alerts.dispatch_cooldown(stream(spark, landed).where("value >= 40"), "reading_id", hours), "c")
    rows = [(r.sensor_id, r.timestamp, r.reading_id) for r in batch.where("value >= 40").collect()]
    newest = max(at for _, at, _ in rows)
    decided = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - dt.timedelta(minutes=10)
    assert {r.reading_id for r in got.collect()} == greedy([r for r in rows if r[1] < decided], hours)


def test_dedupe(spark, landed, batch):
    slim = ["reading_id", "timestamp"]
    twice = stream(spark, landed).select(*slim).unionByName(stream(spark, landed).select(*slim))
    got = drained(spark, alerts.dedupe_alerts(twice, ["reading_id"], horizon="60 days"), "d")
    assert same(got, batch.select(*slim))


def test_spec_join(spark, landed, batch):
    spec = batch.groupBy("asset_type", "metric").agg(F.avg("value").alias("baseline")).withColumn("threshold", F.col("baseline") + 50)
    got = drained(spark, alerts.stream_with_spec(stream(spark, landed), spec).select("reading_id", "status"), "j")
    want = equipment.threshold_breach(equipment.readings_with_spec(batch, spec)).select("reading_id", "status")
    assert same(got, want) and got.count() > 0


@pytest.mark.parametrize("hours", [1, 24])
def test_acknowledgement_timeout(spark, landed, batch, hours):
    columns = ["reading_id", "sensor_id", "timestamp"]
    live = stream(spark, landed)
    got = drained(spark, alerts.ack_timeout(live.where("metric = 'error'").select(*columns),
                                            live.where("metric = 'signup'").select("sensor_id", "timestamp"), hours), "a")
    sent = batch.where("metric = 'error'").select(*columns)
    acks = batch.where("metric = 'signup'").select("sensor_id", F.col("timestamp").alias("at"))
    span = F.expr(f"interval {hours} hours")
    missing = sent.join(acks, (sent["sensor_id"] == acks["sensor_id"]) & F.col("at").between(F.col("timestamp"), F.col("timestamp") + span), "left_anti")
    newest = min(batch.where(f"metric = '{m}'").agg(F.max("timestamp")).head()[0] for m in ("error", "signup"))
    settled = F.col("timestamp") + span + F.expr("interval 1 minute") < F.lit(newest) - F.expr("interval 10 minutes")
    assert same(got, missing.where(settled)) and got.count() > 0


def test_restart_neither_loses_nor_repeats(spark, small, batch):
    root = new_path(spark, "restart")
    events = Inputs(spark, small).raw_events
    for part in ("event_id < 400", "event_id >= 400"):
        events.where(part).write.mode("append").parquet(f"{root}/in")
        live = readings_of(sources.file_stream(spark, f"{root}/in", EVENTS)).select("reading_id", "value")
        got = sinks.drain_to_table(live, f"{root}/t", f"{root}/c")
    assert same(got, batch.select("reading_id", "value"))


def test_kept_table_follows_new_files(spark, small, batch):
    root = new_path(spark, "kept")
    events = Inputs(spark, small).raw_events
    events.where("event_id < 300").write.parquet(f"{root}/in")
    live = readings_of(sources.file_stream(spark, f"{root}/in", EVENTS)).select("reading_id", "value")
    running = sinks.keep_table(live, f"{root}/t", f"{root}/c", "200 milliseconds")
    try:
        running.processAllAvailable()
        assert spark.read.parquet(f"{root}/t").count() == 300
        events.where("event_id >= 300").write.mode("append").parquet(f"{root}/in")
        running.processAllAvailable()
    finally:
        running.stop()
    assert same(spark.read.parquet(f"{root}/t"), batch.select("reading_id", "value"))


def test_replayed_batch_changes_nothing(spark, batch):
    path = new_path(spark, "replay")
    write = sinks.exactly_once(path, lambda rows: actions.equipment_dispatch(rows, "2024-02-01", ["reading_id"]))
    for _ in range(2):
        write(batch, 0)
        write(batch.limit(0), 1)
    got = sinks.read_batches(spark, path, actions.equipment_dispatch(batch).schema)
    assert got.count() == actions.equipment_dispatch(batch, "2024-02-01", ["reading_id"]).count() > 0
    assert got.select("action_id").distinct().count() == got.count()


def test_late_rows_are_kept_aside(spark):
    root = new_path(spark, "late")
    write = sinks.late_data_audit(f"{root}/late", f"{root}/progress")
    at = dt.datetime(2024, 1, 1, 12)

    def rows(*minutes):
        return spark.createDataFrame([(m, at + dt.timedelta(minutes=m)) for m in minutes], "n int, timestamp timestamp")

    for _ in range(2):  # the second round is a full replay
        write(rows(0, 60), 0)
        write(rows(50, 49, 70), 1)
        write(rows(60, 59, -5), 2)
    late = sinks.read_batches(spark, f"{root}/late", rows(1).schema)
    assert sorted((r.batch_id, r.n) for r in late.collect()) == [(1, 49), (2, -5), (2, 59)]


STATEFUL = ["breach_counts_tumbling", "readings_sliding", "breach_sessions", "dedupe_alerts", "dispatch_cooldown", "ack_timeout",
            "exactly_once_actions"]
STATELESS = ["stream_with_spec", "feed_stream"]


@pytest.fixture(scope="module")
def layouts(spark, small):
    """The same events as one file, as a folder of files, and as interleaved files read in several micro-batches."""
    events = Inputs(spark, small).raw_events
    folder = new_path(spark, "folder")
    events.repartition(3, F.col("event_id") % 3).write.parquet(f"{folder}/events.parquet")
    size = sinks.time_slices(spark, f"{folder}/events.parquet", 1)
    return {"file": Inputs(spark, small), "folder": Inputs(spark, folder), "batches": Inputs(spark, folder, max(1, size // 4))}


@pytest.mark.parametrize("name", STATEFUL + STATELESS)
def test_results_do_not_depend_on_files_or_batches(layouts, name):
    one, several, batches = (getattr(streams, name)(i).collect() for i in layouts.values())
    assert sorted(map(str, one)) == sorted(map(str, several)) == sorted(map(str, batches)) and one


def test_late_rows_are_an_error(spark, small):
    root = new_path(spark, "disorder")
    events = Inputs(spark, small).raw_events
    part = F.ntile(4).over(W.orderBy(F.desc("ts")))
    for n in range(1, 5):  # the newest rows arrive first
        events.withColumn("n", part).where(F.col("n") == n).drop("n").coalesce(1).write.mode("append").parquet(f"{root}/in")
    live = readings_of(sources.file_stream(spark, f"{root}/in", EVENTS, files_per_batch=1))
    with pytest.raises(sinks.RowsDropped):
        sinks.drain_to_table(windows.breach_counts_tumbling(live), f"{root}/t", f"{root}/c")


def test_no_entries_without_events(spark, small):
    folder = new_path(spark, "empty")
    Inputs(spark, small).raw_events.limit(0).write.parquet(f"{folder}/events.parquet")
    assert streams.exactly_once_actions(Inputs(spark, folder)).count() == 0
