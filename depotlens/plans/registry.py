"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adapters import Inputs
from .sql_adapters import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: zone-free timestamps, doubles at 6 places, arrays as joined text."""
    cols = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(kind, T.DoubleType):
            c = F.round(c, 6) + F.lit(0e0)
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(kind, T.IntegerType):
            c = c.cast("bigint")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``; ``sql`` may use the adapter CTEs."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(Inputs(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn
    return add
