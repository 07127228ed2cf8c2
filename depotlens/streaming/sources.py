"""File streams of landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .. import schemas


BYTES_PER_BATCH = 8 * 1024**3


def file_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                bytes_per_batch: int = BYTES_PER_BATCH, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the files of a folder, or of what a path pattern names: a file or a folder of part files.

    A micro-batch is bounded in bytes, or in files when ``files_per_batch`` is given. The bound also
    limits what a hot key can bring to one stateful task.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.load(path)


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType | str, **limits) -> DataFrame:
    """A stream over a Parquet table of ``folder``, whether it is one file or a folder of part files."""
    # A pattern, because a plain path to a single file is not accepted as a source.
    return file_stream(spark, f"{folder}/{name}.parque[t]", schema, **limits)


def inventory_stream(spark: SparkSession, path: str, fmt: str = "json", bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """Continuous ingest of inventory snapshots."""
    return file_stream(spark, path, schemas.INVENTORY_SNAPSHOT, fmt, bytes_per_batch)


def readings_stream(spark: SparkSession, path: str, fmt: str = "json", bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """Continuous ingest of equipment readings."""
    return file_stream(spark, path, schemas.EQUIPMENT_READINGS, fmt, bytes_per_batch)
