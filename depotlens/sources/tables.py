"""Reading landed tables and writing day-partitioned ones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas

CORRUPT = "_corrupt_record"


def _with_defaults(df: DataFrame, table: str) -> DataFrame:
    for column, value in schemas.DEFAULTS.get(table, {}).items():
        df = df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    return df


def read_table(spark: SparkSession, path: str, table: str, allow_missing: bool = True,
               multi_line: bool = True) -> DataFrame:
    """One warehouse table from JSON: array files, or JSON lines with ``multi_line=False``.

    A missing path gives an empty table. Unparsable records are kept in ``_corrupt_record`` rather
    than dropped. JSON arrays cannot be split, so bulk history should be lines or Parquet.
    """
    schema = StructType([*schemas.TABLES[table].fields, StructField(CORRUPT, StringType())])
    try:
        df = (
            spark.read.schema(schema).option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").json(path)
        )
    except AnalysisException as error:
        if not allow_missing or "PATH_NOT_FOUND" not in str(error):
            raise
        df = spark.createDataFrame([], schema)
    return _with_defaults(df, table)


def telemetry_bundle(spark: SparkSession, folder: str, kind: str = "all", suffix: str = ".json",
                     multi_line: bool = True) -> dict[str, DataFrame]:
    """The tables of a kind, lazily; an unknown kind selects none."""
    return {
        name: read_table(spark, f"{folder}/{table}{suffix}", table, multi_line=multi_line)
        for name, table in schemas.BUNDLE.items() if kind in (name, "all")
    }


# Packed files cannot be split by their readers: some 50 MB each of the widest table, before packing less than a reader's split.
PACKED_ROWS = 100_000


def write_landing(df: DataFrame, path: str, packed: bool = False) -> None:
    """JSON lines with microsecond times, as ``read_table`` and the file stream read them.

    ``packed`` files are gzipped, a tenth of the size or less, and hold at most ``PACKED_ROWS`` rows. A stream's rate limit counts bytes of
    files, so what a stream reads is landed as it is.
    """
    writer = df.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").mode("append")
    if packed:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", PACKED_ROWS)
    writer.json(path)


def write_partitioned(df: DataFrame, path: str, ts_col: str) -> None:
    """Append rows to a table partitioned by the UTC day of ``ts_col``.

    The rebalance hint lets AQE merge small day groups into few files and split a heavy day.
    """
    daily = df.withColumn("day", F.to_date(ts_col))
    daily.hint("rebalance", F.col("day")).write.partitionBy("day").mode("append").parquet(path)


def read_partitioned(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    if table is None:
        return spark.read.parquet(path)
    schema = StructType([*schemas.TABLES[table].fields, StructField("day", schemas.DAY)])
    return spark.read.schema(schema).parquet(path)
