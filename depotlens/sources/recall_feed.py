"""Landed recall payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# Payload field by recall column.
FIELD_OF_COLUMN = {
    "recall_number": "recall_number",
    "status": "status",
    "classification": "classification",
    "product": "product_description",
    "reason": "reason_for_recall",
    "vendor": "recalling_firm",
    "distribution": "distribution_pattern",
    "lot_numbers": "code_info",
    "quantity": "product_quantity",
    "recall_date": "recall_initiation_date",
    "termination_date": "termination_date_initiated",
}


def read_recall_payloads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schemas.RECALL_PAYLOAD).option("multiLine", multi_line).json(path)


def flatten_recalls(payloads: DataFrame) -> DataFrame:
    """One row per recall with renamed columns and the payload's reported total.

    ``total`` falls back to the payload's own row count. Missing fields are null. Dates arrive as
    ``yyyymmdd`` text.
    """
    rows = payloads.select(
        F.coalesce("meta.results.total", F.size("results").cast("long")).alias("total"), F.explode("results").alias("_r"))
    columns = [F.col(f"_r.{field}").alias(name) for name, field in FIELD_OF_COLUMN.items()]
    flat = rows.select(*columns, "total")
    return flat.withColumn("recall_date", F.to_date(F.try_to_timestamp("recall_date", F.lit("yyyyMMdd"))))
