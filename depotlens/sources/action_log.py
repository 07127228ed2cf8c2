"""Append-only action log and notification outbox.

The log is a table partitioned by the UTC day of its entries, keyed by (action_id, seq). An append adds only entries that the log does
not hold: it reads the ids of the days that it writes, so a job that runs again adds nothing and its cost does not grow with the
log's age. Appends to one log follow each other; two at the same time may both miss what the other is writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .. import schemas
from ..operators.actions import ACTION_COLUMNS, log_entries
from .scratch import exists, materialise, own_folder


def append_actions(actions: DataFrame, path: str) -> None:
    """Append log entries. Actions of loops 2 and 3 add a record and a summary, loop 1 a summary.

    Entries are told apart by their deterministic ids: the same actions appended again, or twice in one frame, stay one.
    """
    with own_folder(actions.sparkSession, "append"):
        _append(actions, path)


def _append(actions: DataFrame, path: str) -> None:
    """The actions are stored once, and entries made of them where they are read: wide rows move only for an id that repeats or a day among several."""
    spark, day = actions.sparkSession, F.to_date("timestamp").alias("day")
    stored = materialise(actions.select(*ACTION_COLUMNS), "actions", compression="zstd")
    days = [r.day for r in stored.select(day).distinct().collect()]  # a row per day
    entries = _entries_once(stored).select("*", day)
    if exists(spark, path):
        known = known_entries(spark, path, days).select(*(F.col(c).alias(f"_{c}") for c in ("day", "action_id", "seq")))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("day", "action_id", "seq")]
        entries = entries.join(known, same[0] & same[1] & same[2], "left_anti")
    # A day that is known beforehand needs no sort in the writer.
    placed = entries.withColumn("day", F.lit(days[0]).cast("date")) if len(days) == 1 else entries.hint("rebalance", F.col("day"))
    placed.write.mode("append").partitionBy("day").parquet(path)


def _entries_once(actions: DataFrame) -> DataFrame:
    """The entries of stored actions, one per (action_id, seq). Ids are counted by a hash of theirs; only actions whose hash repeats are compared."""
    code = F.xxhash64("action_id")
    counted = actions.groupBy(code.alias("_code")).agg(F.count("*").alias("_n"))
    repeated = materialise(counted.where("_n > 1").select("_code"), "repeated")
    if repeated.isEmpty():
        return log_entries(actions)
    alone, again = (actions.join(repeated, code == F.col("_code"), how) for how in ("left_anti", "left_semi"))
    return log_entries(alone).unionByName(log_entries(again).dropDuplicates(["action_id", "seq"]))


def known_entries(spark: SparkSession, path: str, days: list) -> DataFrame:
    """The entries of some days; other days' folders are not read."""
    wanted = F.col("day").isin([d for d in days if d is not None])
    return _stored(spark, path).where(wanted | F.col("day").isNull() if None in days else wanted)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(StructType([*schemas.ACTION_LOG.fields, StructField("day", schemas.DAY)])).parquet(path)


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """All entries; ``log_order`` sorts them at the edge."""
    return _stored(spark, path).drop("day")


def log_order() -> list:
    return [F.asc("timestamp"), F.asc("action_id"), F.asc("seq")]


def write_outbox(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").parquet(path)
