"""Stream sinks: drained runs, idempotent batch folders and the late-data audit."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import exists
from .sources import BYTES_PER_BATCH


class RowsDropped(RuntimeError):
    """A drained stream dropped rows that came behind its watermark."""


def _finish(query) -> None:
    query.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if dropped:
        raise RowsDropped(f"{dropped} rows came behind the watermark; replay them in time order or keep them with late_data_audit")


def drain_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available into a Parquet table and read it back.

    The file sink commits each micro-batch once, so a restart neither loses nor repeats rows. Rows
    behind the watermark are an error here, not a silent loss.
    """
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    _finish(query)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def time_slices(spark: SparkSession, path: str, bytes_per_slice: int = BYTES_PER_BATCH) -> int:
    """How many slices a stored table (a file or a folder) is replayed in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max(1, math.ceil(files.getContentSummary(place).getLength() / bytes_per_slice))


def cut_by_time(rows: DataFrame, ts: str, path: str, slices: int, bytes_per_slice: int = BYTES_PER_BATCH, bytes_per_file: int = 128 << 20) -> list[str]:
    """Write rows to one folder per slice of their time, in one pass, and return the folders in time order.

    Slices are runs of range partitions, several to a slice, so a slice is written by many tasks. Rows of one time, and those without
    one, which come first, lie in one slice.
    """
    spark = rows.sparkSession
    files = max(1, math.ceil(bytes_per_slice / bytes_per_file)) if slices > 1 else 1
    if slices > 1:
        rows = rows.repartitionByRange(slices * files, F.col(ts).asc_nulls_first())
    cut = rows.withColumn("_slice", F.floor(F.spark_partition_id() / files).cast("int") if slices > 1 else F.lit(0))
    cut.write.partitionBy("_slice").parquet(path)
    return [folder for folder in (f"{path}/_slice={k}" for k in range(slices)) if exists(spark, folder)]


def replay_in_order(rows: DataFrame, ts: str, build: Callable[[Callable[[], DataFrame]], DataFrame], root: str,
                    slices: int = 1, drain: Callable[[DataFrame, str], DataFrame] | None = None,
                    bytes_per_slice: int = BYTES_PER_BATCH) -> DataFrame:
    """Replay stored rows through a streaming query in time order, whatever their files or their order in them.

    The rows are cut by time once and land in ``slices`` steps of about equal size, each one time range and one micro-batch, so no row
    comes behind the watermark and neither files nor batch bounds change the result. ``build`` makes the
    query from a function that opens the landed stream; rows without a time come first.
    """
    spark, landing = rows.sparkSession, f"{root}/landing"
    run = drain or (lambda stream, base: drain_to_table(stream, f"{base}/table", f"{base}/checkpoint"))
    for folder in cut_by_time(rows, ts, f"{root}/cut", slices, bytes_per_slice) or [None]:
        part = rows.limit(0) if folder is None else spark.read.schema(rows.schema).parquet(folder)
        part.write.mode("append").parquet(landing)
        # No rate limit: what has landed since the last run is one micro-batch.
        result = run(build(lambda: spark.readStream.schema(rows.schema).parquet(landing)), root)
    return result


def keep_table(stream: DataFrame, path: str, checkpoint: str, every: str = "60 seconds", mode: str = "append"):
    """Keep appending to a Parquet table at an interval; returns the running query."""
    return (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is available through a batch function."""
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    _finish(query)


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def exactly_once(path: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function that overwrites the batch's own folder, so a replayed batch changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(batch_folder(path, batch_id))
    return write


def late_data_audit(path: str, progress: str, ts: str = "timestamp", delay: str = "10 minutes",
                    ) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps rows older than the watermark in a side table.

    The watermark is the newest time of earlier batches minus ``delay``. Each batch stores the newest
    time up to it under its id and reads only the one before, so the audit survives restarts and
    replays and its cost does not grow with the number of batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max(ts).alias("newest"))
        limit = None
        if batch_id:
            before = batch.sparkSession.read.schema(newest.schema).parquet(batch_folder(progress, batch_id - 1))
            limit = before.head().newest
            newest = newest.select(F.greatest("newest", F.lit(limit)).alias("newest"))
        newest.write.mode("overwrite").parquet(batch_folder(progress, batch_id))
        late = batch.where(F.lit(False)) if limit is None else batch.where(
            F.col(ts) < F.lit(limit) - F.expr(f"interval {delay}"))
        late.write.mode("overwrite").parquet(batch_folder(path, batch_id))
    return write


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table written in batch folders, with ``batch_id``."""
    from pyspark.sql.types import LongType, StructField, StructType
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    return spark.read.schema(full).parquet(path)
