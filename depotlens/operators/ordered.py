"""Sequence operators that never hold a whole key, or the whole table, in one task.

A plain window needs all rows of a key in one task. Readings, scores and events have hot keys, so
these helpers cut a key's timeline into slices, work inside each slice, and carry a small per-slice
summary across slices. Summaries are bounded by the time span, not by the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timing import slice_no as _slice_no
from ..sources.scratch import materialise

SLICE_SECONDS = 60
CHUNK_ROWS = 100_000

# Slice of rows without a time: before every real one, as null times sort first.
_NO_TIME = -(1 << 40)


def slice_no(ts: str, width: int) -> Column:
    return F.coalesce(_slice_no(ts, width), F.lit(_NO_TIME))


def with_ordinal(df: DataFrame, keys: list[str], ts: str, tie: list[str], name: str = "ordinal",
                 slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """1-based position of each row in its key's (ts, tie) order.

    Rows are numbered inside (key, slice) and shifted by the row count of the key's earlier slices.
    The row side keeps the window's partitioning for the join, so rows shuffle once.
    """
    # A struct is never null itself, so keys with null fields survive the join.
    sliced = df.withColumn("_key", F.struct(*keys)).withColumn("_slice", slice_no(ts, slice_seconds))
    earlier = W.partitionBy("_key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_key", "_slice").agg(F.count("*").alias("_n"))
        .select("_key", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy("_key", "_slice").orderBy(ts, *tie)
    return (
        sliced.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, ["_key", "_slice"])
        .withColumn(name, F.col("_rn") + F.col("_before"))
        .drop("_key", "_slice", "_rn", "_before")
    )


def over_previous(df: DataFrame, keys: list[str], ordinal: str, size: int, columns: dict[str, Column],
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add window ``columns`` computed over the ``size`` rows before each row of its key.

    ``columns`` maps a new name to an aggregate expression. Chunks hold ``chunk_rows`` consecutive
    rows; the last ``size`` rows of a chunk are repeated as a lead-in of the next one.
    """
    if size > chunk_rows:
        raise ValueError("the frame must fit into one chunk")
    position = F.col(ordinal) - 1
    own = F.floor(position / F.lit(chunk_rows)).cast("long")
    is_lead = (position % chunk_rows) >= (chunk_rows - size)
    placed = df.withColumn("_place", F.explode(
        F.when(is_lead, F.array(F.struct(own.alias("chunk"), F.lit(False).alias("lead")),
                                F.struct((own + 1).alias("chunk"), F.lit(True).alias("lead"))))
        .otherwise(F.array(F.struct(own.alias("chunk"), F.lit(False).alias("lead"))))
    )).withColumn("_chunk", F.col("_place.chunk")).withColumn("_lead", F.col("_place.lead")).drop("_place")
    frame = W.partitionBy(*keys, "_chunk").orderBy(ordinal).rowsBetween(-size, -1)
    return (
        placed.select("*", *[expr.over(frame).alias(name) for name, expr in columns.items()])
        .where(~F.col("_lead")).drop("_chunk", "_lead")
    )


def runs(df: DataFrame, keys: list[str], ts: str, tie: list[str], flag: str, aggregates: dict[str, tuple[str, Column]],
         slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Maximal runs of rows with ``flag`` true, per key in (ts, tie) order.

    ``aggregates`` maps an output name to (combine function, row expression) with combine in
    ``min``, ``max`` and ``sum``. Runs are built inside (key, slice). Only the first and last run of
    a slice can continue in a neighbour slice; those share a group per key in the second pass, every
    other run is a group of its own there.
    """
    combine = {"min": F.min, "max": F.max, "sum": F.sum}
    in_slice = W.partitionBy("_key", "_slice").orderBy(ts, *tie)
    rows = df.select(
        F.struct(*keys).alias("_key"), slice_no(ts, slice_seconds).alias("_slice"), F.col(ts), *tie,
        F.coalesce(F.col(flag), F.lit(False)).alias("_flag"),
        *[expr.alias(f"_in_{name}") for name, (_, expr) in aggregates.items()],
    )
    change = F.when(F.col("_flag") == F.lag("_flag").over(in_slice), 0).otherwise(1)
    pieces = (
        rows.withColumns({"_change": change, "_last": F.lead(ts).over(in_slice).isNull()})
        .withColumn("_run", F.sum("_change").over(in_slice.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("_key", "_slice", "_run")
        .agg(F.bool_or("_flag").alias("_flag"), F.bool_or("_last").alias("_last"),
             *[combine[how](f"_in_{name}").alias(name) for name, (how, _) in aggregates.items()])
    )
    boundary = (F.col("_run") == 1) | F.col("_last")
    placed = pieces.where(boundary | F.col("_flag")).withColumn("_slot", F.when(~boundary, F.struct("_slice", "_run")))
    across = W.partitionBy("_key", "_slot").orderBy("_slice", "_run")
    continues = (F.col("_run") == 1) & (F.col("_flag") == F.lag("_flag").over(across))
    return (
        placed.withColumn("_start", F.when(continues, 0).otherwise(1))
        .withColumn("_group", F.sum("_start").over(across.rowsBetween(W.unboundedPreceding, 0)))
        .where("_flag")
        .groupBy("_key", "_slot", "_group")
        .agg(*[combine[how](name).alias(name) for name, (how, _) in aggregates.items()])
        .select("_key.*", *aggregates)
    )


def next_within(df: DataFrame, keys: list[str], ts: str, is_target: Column, horizon_seconds: int,
                name: str = "next_ts", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Per row, the first target time at or after it, searched up to ``horizon_seconds`` ahead.

    No pairs are formed: the own slice is scanned by a window, later slices contribute one minimum
    each. The result may lie past the horizon by less than a slice; callers compare exactly.
    """
    marked = (
        df.withColumn("_key", F.struct(*keys)).withColumn("_slice", slice_no(ts, slice_seconds))
        .withColumn("_target", F.when(is_target, F.col(ts)))
    )
    reach = horizon_seconds // slice_seconds + 1
    later = W.partitionBy("_key").orderBy("_slice").rangeBetween(1, reach)
    summary = (
        marked.groupBy("_key", "_slice").agg(F.min("_target").alias("_first"))
        .select("_key", "_slice", F.min("_first").over(later).alias("_later"))
    )
    # Read backwards, the frame only ever grows: one pass, where a frame that shrinks is summed anew for each row.
    ahead = W.partitionBy("_key", "_slice").orderBy(F.col(ts).desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    return (
        marked.withColumn("_own", F.min("_target").over(ahead))
        .join(summary, ["_key", "_slice"])
        .withColumn(name, F.coalesce("_own", "_later"))
        .drop("_key", "_slice", "_target", "_own", "_later")
    )


def prefix_sums(df: DataFrame, order: list[Column], weights: dict[str, Column | int], scratch: str) -> DataFrame:
    """Exclusive running sums of ``weights`` (by new column name) over the whole table in ``order``.

    The order must be total. Range partitions are written once, so partition numbers stay fixed
    between the pass that sums each partition and the pass that numbers its rows. The offset table
    has one row per partition, which bounds its broadcast. A number as weight is that of every row:
    such sums follow from a row's place in its sorted partition, and need no second exchange of the rows.
    """
    equal = {name: weight for name, weight in weights.items() if isinstance(weight, int)}
    given = {name: weight for name, weight in weights.items() if name not in equal}
    ranged = df.withColumns({f"_w_{name}": weight for name, weight in given.items()}).repartitionByRange(*order)
    if equal:
        # The low 33 bits of the id are the row's place.
        ranged = ranged.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = materialise(ranged.withColumn("_part", F.spark_partition_id()), scratch, compression="zstd")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = {name: F.sum(f"_w_{name}") for name in given} | {name: F.count("*") * weight for name, weight in equal.items()}
    offsets = ranged.groupBy("_part").agg(*[total.alias(f"_t_{n}") for n, total in totals.items()]).select(
        "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in weights])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = {n: F.col("_place") * weights[n] if n in equal else F.coalesce(F.sum(f"_w_{n}").over(inside), F.lit(0)) for n in weights}
    return (
        ranged.select("*", *[own.alias(f"_i_{n}") for n, own in sums.items()])
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(n) for n in weights])
    )


def rekeyed(df: DataFrame, key: str, name: str) -> DataFrame:
    """An aggregate by a string ``key``, under a new key column that Spark must exchange again.

    AQE splits skewed partitions only of joins that read both sides straight from an exchange. An
    aggregate by the join key would reuse its own partitioning and block that. The exchange moves one
    row per key.
    """
    return df.withColumn(name, F.concat(F.col(key), F.lit(""))).drop(key)


def top_k(df: DataFrame, keys: list[Column], k: int) -> DataFrame:
    """ORDER BY + LIMIT; Catalyst plans TakeOrderedAndProject, so each task keeps k rows."""
    return df.orderBy(*keys).limit(k)


def newest_per(df: DataFrame, partition: list[str], by: list[str], columns: list[str] | None = None) -> DataFrame:
    """The row with the greatest ``by`` per group, reduced to ``columns``.

    An aggregate with map-side combine: it sorts by group only, where a window sorts whole rows. The
    picked struct cannot be pruned later, so callers name the columns they need.
    """
    columns = columns or df.columns
    kept = [c for c in columns if c not in partition]
    picked = df.groupBy(*partition).agg(F.max_by(F.struct(*kept), F.struct(*by)).alias("_row"))
    return picked.select(*[F.col(c) if c in partition else F.col(f"_row.{c}") for c in columns])


def top_k_per(df: DataFrame, partition: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group. The group limit is applied before the shuffle, so hot groups stay small."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*partition).orderBy(*order)))
    return ranked.where(F.col(name) <= k)
