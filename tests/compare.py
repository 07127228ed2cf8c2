"""Compare registered queries with their SQL on one data folder.

Usage: ``python -m tests.compare /root/testdata/sf0.01 [name …] [spark.setting=value …]``
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

DUCK_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _rows(columns: list[str], rows: list) -> list[tuple]:
    def cell(v):
        if v is None:
            return "∅"
        return repr(v) if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple(cell(row[n]) for n in order) for row in rows)


def difference(spark: SparkSession, con, folder: str, fn, sql: str | None) -> str | None:
    """None when equal, else a short description. Without SQL only the run is checked."""
    got = fn(spark, folder)
    actual = got.collect()
    if sql is None:
        return None if actual else "no rows"
    relation = con.sql(sql)
    expected_types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    actual_types = {name: DUCK_TYPES.get(kind, kind) for name, kind in got.dtypes}
    if expected_types != actual_types:
        return f"schema: {sorted(actual_types.items())} != {sorted(expected_types.items())}"
    left, right = _rows(got.columns, actual), _rows(relation.columns, relation.fetchall())
    if left == right:
        return None if left else "no rows on either side"
    a, b = Counter(left), Counter(right)
    extra, missing = list((a - b).elements()), list((b - a).elements())
    return f"rows {len(left)} vs {len(right)}; only spark {len(extra)} {extra[:2]}; only sql {len(missing)} {missing[:2]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from depotlens.session import builder

    folder, names = sys.argv[1], sys.argv[2:]
    settings = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"}
    settings.update(pair.split("=", 1) for pair in names if "=" in pair)
    names = [name for name in names if "=" not in name]
    spark = builder("compare", **settings).master("local[8]").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            result = difference(spark, con, folder, fn, sqls.get(name))
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in sqls else '(rows only)'} {result or ''}",
              flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
