"""Alert streams: replay dedupe, dispatch cooldown, spec join, acknowledgement timeout, live feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import equipment, feed
from .windows import WATERMARK


def dedupe_alerts(alerts: DataFrame, keys: list[str], ts: str = "timestamp", horizon: str = "1 hour") -> DataFrame:
    """Drop replayed alerts: rows with equal keys whose times lie within the horizon.

    One row per key survives a micro-batch whatever its times, so keys must identify the alert.
    """
    return alerts.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def dispatch_cooldown(alerts: DataFrame, row_id: str, hours: float = 8, key: str = "sensor_id",
                      ts: str = "timestamp", watermark: str = WATERMARK) -> DataFrame:
    """At most one alert per key and ``hours``: an alert passes if the last passed one is old enough.

    Alerts wait in state until the watermark has passed them and are then decided in event order, so
    neither the order of files nor the bounds of micro-batches matter. State per key is the last passed
    time and the alerts of the watermark's delay; it ends when the cooldown has run out. A key's alerts of
    one micro-batch meet in its task: the source's rate limit bounds them, and only times and ids travel.
    """
    hold = int(hours * 3600 * 1_000_000)

    def passed(group, chunks, state):
        import numpy as np
        import pandas as pd

        last, waiting_at, waiting_id = state.get if state.exists else (None, [], [])
        times, ids = [np.array(waiting_at, np.int64)], [np.array(waiting_id)]
        for chunk in chunks:
            times.append(chunk["at"].to_numpy())
            ids.append(chunk["row_id"].to_numpy())
        ids = [i for t, i in zip(times, ids) if len(t)] or [np.array([])]
        at, row = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((row, at))
        at, row = at[order], row[order]
        reached = state.getCurrentWatermarkMs() * 1000
        final = int(np.searchsorted(at, reached))  # no alert can come before these any more
        kept = []
        position = 0 if last is None else int(np.searchsorted(at, last + hold))
        while position < final:
            kept.append(position)
            last = int(at[position])
            position = int(np.searchsorted(at, last + hold))
        rest = slice(max(final, 0 if last is None else int(np.searchsorted(at, last + hold))), None)
        left_at, left_id = at[rest].tolist(), row[rest].tolist()
        ends = left_at[0] if left_at else None if last is None else last + hold
        if ends is None or not left_at and ends < reached:
            state.remove()
        else:
            state.update((last, left_at, left_id))
            state.setTimeoutTimestamp(max(ends, reached) // 1000 + 1)
        yield pd.DataFrame({"key": [group[0]] * len(kept), "row_id": row[kept], "at": at[kept]})

    slim = alerts.withWatermark(ts, watermark).select(
        F.col(key).alias("key"), F.col(row_id).alias("row_id"), F.unix_micros(ts).alias("at"), F.col(ts).alias("seen"))  # the timer needs the watermarked column
    key_type = slim.schema["key"].dataType.simpleString()
    id_type = slim.schema["row_id"].dataType.simpleString()
    kept = slim.groupBy("key").applyInPandasWithState(
        passed, f"key {key_type}, row_id {id_type}, at bigint", f"last bigint, at array<bigint>, ids array<{id_type}>",
        "append", "EventTimeTimeout")
    return kept.select(F.col("key").alias(key), F.col("row_id").alias(row_id), F.timestamp_micros("at").alias(ts))


def escalations(events: DataFrame, hours: float = 1, breach_type: str = "temperature_breach", watermark: str = WATERMARK) -> DataFrame:
    """Breaches that no resolved event of the same asset follows within the SLA, as soon as it has passed: ``(asset_id, event_id, timestamp, status)``.

    A resolved event is one with status RESOLVED; it counts at ``resolved_at``, else at its own time. A breach waits in state until the
    watermark is past its deadline; a timer of the asset fires there, whether events come or not. The state holds the open breaches of
    ``hours`` and the delay, and of resolutions the first and last of each minute, which decide as all of them would. Equal to
    ``unresolved_after`` on breaches whose deadline has passed, whatever the order of rows and files.
    """
    span, minute = int(hours * 3_600_000_000), 60_000_000

    def overdue(group, chunks, state):
        import numpy as np
        import pandas as pd

        breach_at, breach_id, done = state.get if state.exists else ([], [], [])
        breaches, ended = list(zip(breach_at, breach_id)), [np.array(done, np.int64)]
        for chunk in chunks:
            resolved = chunk["resolved"].to_numpy(bool)
            ended.append(chunk["at"].to_numpy()[resolved])
            breaches += list(zip(chunk["at"][~resolved].tolist(), chunk["event_id"][~resolved].tolist()))
        ended = np.sort(np.concatenate(ended))
        reached = state.getCurrentWatermarkMs() * 1000
        late, waiting = [], []
        for at, event in sorted(breaches, key=lambda b: b[0]):
            first = int(np.searchsorted(ended, at))
            answered = first < len(ended) and ended[first] <= at + span
            if at + span < reached:
                late += [] if answered else [(group[0], event, at)]
            elif not answered:
                waiting.append((at, event))
        # Breaches still to come lie behind the watermark, those that wait may lie before it.
        ended = ended[ended >= min([reached, *(at for at, _ in waiting)])]
        minutes = ended // minute
        edges = np.flatnonzero(np.diff(minutes)) + 1 if len(ended) else np.zeros(0, np.int64)
        keep = np.unique(np.r_[0, edges, edges - 1, len(ended) - 1].astype(np.int64)) if len(ended) else edges
        if not waiting and not len(ended):
            if state.exists:
                state.remove()
        else:
            state.update(([at for at, _ in waiting], [event for _, event in waiting], ended[keep].tolist()))
            due = min([at + span for at, _ in waiting] or [int(ended[-1])])
            state.setTimeoutTimestamp(max(due, reached) // 1000 + 1)
        yield pd.DataFrame(late, columns=["asset_id", "event_id", "at"]).astype({"at": "int64"})

    resolved = F.col("status") == "RESOLVED"
    rows = events.withColumn("_seen", F.when(resolved, F.coalesce("resolved_at", "timestamp")).otherwise(F.col("timestamp")))
    rows = rows.where(resolved | (F.col("event_type") == breach_type)).withWatermark("_seen", watermark)
    slim = rows.select("asset_id", "event_id", resolved.alias("resolved"), F.unix_micros("_seen").alias("at"), "_seen")  # the timer needs the watermarked column
    asset, event = (slim.schema[c].dataType.simpleString() for c in ("asset_id", "event_id"))
    found = slim.groupBy("asset_id").applyInPandasWithState(
        overdue, f"asset_id {asset}, event_id {event}, at bigint", f"breach_at array<bigint>, breach_id array<{event}>, ended array<bigint>",
        "append", "EventTimeTimeout")
    return found.select("asset_id", "event_id", F.timestamp_micros("at").alias("timestamp"), F.lit("ESCALATED").alias("status"))


def stream_with_spec(readings: DataFrame, spec: DataFrame) -> DataFrame:
    """Stream-static join that attaches baseline and threshold, then keeps breaches."""
    return equipment.threshold_breach(equipment.readings_with_spec(readings, spec))


def ack_timeout(dispatches: DataFrame, acks: DataFrame, hours: int = 1, key: str = "sensor_id",
                watermark: str = WATERMARK, salts: int = 8) -> DataFrame:
    """Dispatches that no acknowledgement of the same key follows within the horizon.

    Inputs carry ``timestamp``. Acknowledgements are first cut down to the first and last time per
    key and minute. That is enough to decide whether one falls into ``[t, t + horizon]``, and a
    dispatch meets at most one row per minute instead of every acknowledgement. These few rows are
    repeated for every salt, so that a hot key's dispatches spread over ``salts`` join partitions.
    """
    salt = F.pmod(F.xxhash64(*dispatches.columns), F.lit(salts))
    sent = dispatches.withWatermark("timestamp", watermark).withColumn("_salt", salt)
    minutes = (
        acks.withWatermark("timestamp", watermark)
        .groupBy(F.col(key).alias("_ack_key"), F.window("timestamp", "1 minute").alias("_w"))
        .agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
        .select("_ack_key", F.window_time("_w").alias("_at"), "_first", "_last",
                F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_ack_salt"))
    )
    horizon = F.expr(f"interval {hours} hours")
    near = (F.col("_at") >= F.col("timestamp")) & (F.col("_at") <= F.col("timestamp") + horizon + F.expr("interval 1 minute"))
    inside = (F.col("_last") >= F.col("timestamp")) & (F.col("_first") <= F.col("timestamp") + horizon)
    same = (F.col(key) == F.col("_ack_key")) & (F.col("_salt") == F.col("_ack_salt"))
    joined = sent.join(minutes, same & near & inside, "leftOuter")
    return joined.where(F.col("_ack_key").isNull()).drop("_ack_key", "_at", "_first", "_last", "_salt", "_ack_salt")


def feed_stream(readings: DataFrame, events: DataFrame) -> DataFrame:
    """Breaches and open compliance events as one continuous feed."""
    return feed.equipment_events(readings).unionByName(feed.compliance_feed(events))
