"""``as_of`` handling and time buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_ts(as_of) -> Column:
    """A timestamp column from a Column, datetime, date, ISO string or None (= now)."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, dt.datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(dt.timezone.utc)
        # A rendered literal avoids the driver's local zone shifting naive datetimes.
        return F.lit(as_of.strftime("%Y-%m-%dT%H:%M:%S.%fZ")).cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def time_slice(df: DataFrame, ts: str, as_of, span: str) -> DataFrame:
    """Rows with ``as_of - span <= ts <= as_of``.

    Plain Parquet does not derive partition ranges from a timestamp predicate, so when the table
    carries its ``day`` partition column the bound is repeated on it to prune folders.
    """
    upper = as_ts(as_of)
    lower = upper - F.expr(f"interval {span}")
    if dict(df.dtypes).get(ts) == "date":
        upper, lower = F.to_date(upper), F.to_date(lower)
    if "day" in df.columns and ts != "day":
        df = df.where((F.col("day") >= F.to_date(lower)) & (F.col("day") <= F.to_date(upper)))
    return df.where((F.col(ts) >= lower) & (F.col(ts) <= upper))


def seconds(ts) -> Column:
    return F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts)


def slice_no(ts, width: int) -> Column:
    """Number of the ``width``-second slice that holds ``ts``."""
    return F.floor(seconds(ts) / F.lit(width)).cast("long")


def shift_start(ts, hours: int = 8) -> Column:
    """Start of the ``hours``-hour shift (aligned to midnight UTC) that holds ``ts``."""
    width = hours * 3600
    return F.timestamp_seconds(slice_no(ts, width) * width)


def days_between(later, earlier) -> Column:
    return F.datediff(later, earlier).cast("long")


def dwell_hours(received, as_of) -> Column:
    """Hours from receipt to ``as_of``."""
    received = F.col(received) if isinstance(received, str) else received
    return (F.unix_seconds(as_ts(as_of)) - F.unix_seconds(received.cast("timestamp"))) / F.lit(3600e0)


def days_to_expiry(expiry, as_of) -> Column:
    return days_between(F.col(expiry) if isinstance(expiry, str) else expiry, F.to_date(as_ts(as_of)))


def parse_iso_utc(text) -> Column:
    """``2024-01-01T00:00:00.123456Z`` strings to an instant; unparsable text gives null."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)
