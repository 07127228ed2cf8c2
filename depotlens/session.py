"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE re-plans joins from measured sizes and splits skewed partitions; UTC keeps day
# boundaries and oracle comparisons stable. Shuffle partitions are left to the caller: AQE
# coalesces a generous initial number, so a cluster should start high.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Merge a hot key's sessions before the shuffle as well.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def builder(app: str = "depotlens", **overrides: str):
    b = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **overrides}.items():
        b = b.config(key, value)
    return b
