"""Sliced sequence operators against plain windows, with hot keys, null keys and tiny slices."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.operators import equipment, inventory, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = []
    for n in range(3000):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        # Whole-minute times force ties; bursts fill single slices.
        at = start + dt.timedelta(seconds=rng.randrange(0, 4000) if rng.random() < 0.7 else 60 * rng.randrange(0, 60))
        data.append((n, key, at, float(rng.randrange(0, 100))))
    data.append((3000, "hot", None, 5.0))
    return spark.createDataFrame(data, "id long, key string, at timestamp, value double").cache()


@pytest.mark.parametrize("width", [1, 7, 60, 100_000])
def test_ordinal(rows, width):
    plain = rows.withColumn("want", F.row_number().over(W.partitionBy("key").orderBy("at", "id")))
    got = ordered.with_ordinal(rows, ["key"], "at", ["id"], "got", width).select("id", "got")
    joined = plain.join(got, "id")
    assert joined.count() == rows.count()
    assert joined.where("want <> got").count() == 0


@pytest.mark.parametrize("size,chunk", [(1, 1), (5, 5), (50, 64), (50, 100_000)])
def test_frame_over_previous_rows(rows, size, chunk):
    numbered = ordered.with_ordinal(rows, ["key"], "at", ["id"], "n")
    frame = W.partitionBy("key").orderBy("at", "id").rowsBetween(-size, -1)
    want = rows.select("id", F.sum("value").over(frame).alias("want"))
    got = ordered.over_previous(numbered, ["key"], "n", size, {"got": F.sum("value")}, chunk).select("id", "got")
    joined = want.join(got, "id")
    assert joined.count() == rows.count()
    assert joined.where("not (want <=> got)").count() == 0


@pytest.mark.parametrize("width", [1, 13, 600, 100_000])
def test_runs(rows, width):
    flagged = rows.withColumn("flag", F.col("value") >= 40)
    w = W.partitionBy("key").orderBy("at", "id")
    changed = flagged.withColumn("change", F.when(F.col("flag") == F.lag("flag").over(w), 0).otherwise(1))
    want = (
        changed.withColumn("g", F.sum("change").over(w.rowsBetween(W.unboundedPreceding, 0))).where("flag").groupBy("key", "g")
        .agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"), F.max("value").alias("v"), F.min("id").alias("i"))
        .drop("g")
    )
    got = ordered.runs(flagged, ["key"], "at", ["id"], "flag", {
        "a": ("min", F.col("at")), "b": ("max", F.col("at")), "n": ("sum", F.lit(1).cast("long")), "v": ("max", F.col("value")),
        "i": ("min", F.col("id"))}, width)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("width,horizon", [(1, 30), (60, 30), (60, 600), (7, 100)])
def test_next_within(rows, width, horizon):
    timed = rows.where("at is not null")
    targets = timed.where("value < 10").select(F.col("key").alias("k"), F.col("at").alias("t"))
    want = (
        timed.join(targets, F.col("key").eqNullSafe(F.col("k")) & (F.col("t") >= F.col("at")), "left")
        .groupBy("id", "at").agg(F.min("t").alias("t"))
        .select("id", F.when(F.col("t") <= F.col("at") + F.make_dt_interval(secs=F.lit(horizon)), F.col("t")).alias("want"))
    )
    got = ordered.next_within(timed, ["key"], "at", F.col("value") < 10, horizon, "t", width).select(
        "id", F.when(F.col("t") <= F.col("at") + F.make_dt_interval(secs=F.lit(horizon)), F.col("t")).alias("got"))
    joined = want.join(got, "id")
    assert joined.count() == timed.count()
    assert joined.where("not (want <=> got)").count() == 0


def test_prefix_sums(rows):
    got = ordered.prefix_sums(rows, [F.col("value"), F.col("id")], {"n": F.lit(1).cast("long"), "s": F.col("id")}, "test")
    w = W.orderBy("value", "id").rowsBetween(W.unboundedPreceding, -1)
    want = rows.select("id", F.count("*").over(w).alias("wn"), F.coalesce(F.sum("id").over(w), F.lit(0)).alias("ws"))
    assert got.join(want, "id").where("n = wn and s = ws").count() == rows.count()


def test_prefix_sums_of_equal_weights_exchange_rows_once(rows):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = ordered.prefix_sums(rows.repartition(5), [F.desc("value"), F.asc("id")], {"n": 1, "m": 3, "s": F.col("id")}, "test")
    w = W.orderBy(F.desc("value"), "id").rowsBetween(W.unboundedPreceding, -1)
    want = rows.select("id", F.count("*").over(w).alias("wn"), F.coalesce(F.sum("id").over(w), F.lit(0)).alias("ws"))
    assert got.join(want, "id").where("n = wn and m = 3 * wn and s = ws").count() == rows.count()
    placed = ordered.prefix_sums(rows, [F.col("value"), F.col("id")], {"n": 1}, "test")
    assert plan(placed).count("Window [") == 1 and placed.schema["n"].dataType.simpleString() == "bigint"
    assert sorted(r.n for r in placed.collect()) == list(range(rows.count()))
    assert ordered.prefix_sums(rows.limit(0), [F.col("id")], {"n": 1}, "test").collect() == []


def test_rank_with_ties_and_nulls(spark):
    data = [(f"s{n:03}", [0.5, 0.5, 0.25, None, 1.0][n % 5]) for n in range(50)]
    df = spark.createDataFrame(data, "sku_id string, spoilage_risk_score double")
    w = W.orderBy(F.desc_nulls_last("spoilage_risk_score"))
    want = df.select("sku_id", F.row_number().over(W.orderBy(F.desc_nulls_last("spoilage_risk_score"), "sku_id")).alias("a"),
                     F.dense_rank().over(w).alias("b"), F.percent_rank().over(w).alias("c"))
    got = inventory.rank_inventory(df).select("sku_id", "row_num", "dense_rank", "percent_rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_profile_of_one_dominant_value(spark):
    # One value holds most of a metric; a second metric has two readings, a third a single one.
    data = [("m", 7.0)] * 500 + [("m", float(n)) for n in range(20)] + [("k", 1.0), ("k", 2.0), ("j", 4.0), ("j", None)]
    df = spark.createDataFrame(data, "metric string, value double")
    got = {r.metric: (r.n, r.p50, r.p95) for r in equipment.sensor_profile(df).collect()}
    want = {r.metric: (r.n, r.a, r.b) for r in df.groupBy("metric").agg(
        F.count("value").alias("n"), F.expr("percentile(value, 0.5)").alias("a"), F.expr("percentile(value, 0.95)").alias("b")).collect()}
    assert got == {k: (n, pytest.approx(a), pytest.approx(b)) for k, (n, a, b) in want.items()}


def test_limit_is_deterministic_on_ties(spark):
    df = spark.createDataFrame([(f"SKU-{n:03}", 0.7, 50.0) for n in range(60)], "sku_id string, spoilage_risk_score double, dwell_hours double")
    for c in inventory.AT_RISK_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    got = [r.sku_id for r in inventory.inventory_at_risk(df.repartition(7)).collect()]
    assert got == [f"SKU-{n:03}" for n in range(30)]
