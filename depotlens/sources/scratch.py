"""Materialised intermediates in the cluster's shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else ``_scratch`` in the warehouse; executors share both."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def _hadoop_path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _hadoop_path(spark, path)
    return files.exists(place)


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses. It is removed when the application ends in order, or with the ``workspace`` around it."""
    path = f"{_folder.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place, files = _hadoop_path(spark, path)
    files.deleteOnExit(place)
    return path


@contextmanager
def own_folder(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables materialised inside lie in one folder, which goes at the end.

    What is no longer referenced is collected at once, so that the cleaner drops its shuffle files as well.
    """
    own = new_path(spark, name)
    token = _folder.set(own)
    try:
        yield
    finally:
        _folder.reset(token)
        place, files = _hadoop_path(spark, own)
        files.delete(place, True)
        release(spark)


def workspace(spark: SparkSession, name: str, work: Callable[[], DataFrame]) -> DataFrame:
    """Store what ``work`` returns, and remove everything it stored on the way."""
    outer = _folder.get()

    def stored() -> DataFrame:
        result = work()
        inside = _folder.set(outer)
        try:
            return materialise(result, name)
        finally:
            _folder.reset(inside)

    with own_folder(spark, name):
        return stored()


def release(spark: SparkSession) -> None:
    """Let the cleaner drop the shuffle files that nothing refers to any more, without waiting for the next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# Rows of megabytes: a row group each, as Parquet's writer holds a hundred rows before it looks at their size, and its reader 4,096 of a group.
LARGE_ROWS = {"parquet.block.row.count.limit": "1"}


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once and read it back; ``options`` are the writer's.

    Later stages see fixed rows and fixed partition columns even when a task is retried, and a
    lost executor does not restart the lineage.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
