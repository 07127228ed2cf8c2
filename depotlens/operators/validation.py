"""Row checks against the data contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas


def validate_rows(df: DataFrame, table: str) -> DataFrame:
    """One row per violated rule: ``(table_name, row_key, rule, column_name, found)``.

    Rules: ``required`` (null in a required column), ``domain`` (value outside its enum) and
    ``unit_interval`` (score outside [0, 1]).
    """
    def broken(rule, column, condition):
        return F.when(condition, F.struct(
            F.lit(rule).alias("rule"), F.lit(column).alias("column_name"),
            F.col(column).cast("string").alias("found")))

    checks = [broken("required", c, F.col(c).isNull()) for c in schemas.REQUIRED[table]]
    for column, allowed in schemas.DOMAINS[table].items():
        checks.append(broken("domain", column, F.col(column).isNotNull() & ~F.col(column).isin(allowed)))
    for column in schemas.UNIT_INTERVAL[table]:
        outside = ~F.col(column).between(0e0, 1e0) | F.isnan(column)
        checks.append(broken("unit_interval", column, F.coalesce(outside, F.lit(False))))
    return (
        df.select(F.col(schemas.PRIMARY_KEY[table]).cast("string").alias("row_key"),
                  F.explode(F.array_compact(F.array(*checks))).alias("_v"))
        .select(F.lit(table).alias("table_name"), "row_key", "_v.*")
    )
