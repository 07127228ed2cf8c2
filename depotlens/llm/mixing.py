"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources are ordered by code point with null last and weigh ``weights`` in turn. Their targets share the words of all
documents by weight; a target stops at ``limit`` times the words of its source, and the excess is shared again among the
others by weight.

A source that takes ``rate = target / words`` of itself gives every document ``floor(rate)`` certain copies. The rest of its
target is a sample: with inclusion odds p = rate - floor(rate) and a uniform number u from the document's id and text, a
document ranks by (u / (1 - u)) / (p / (1 - p)), and the lowest ranks enter as long as the rest is not passed. The last
place goes to the following document whose words come nearest to what is still open, ties to the lower rank, or to none if
none comes nearer.

The rank of a hot source is never sorted in one task: a rank becomes a number in [0, 1), words are summed per 1/4096 of it,
then per 1/4096 of the cell in which the rest is reached, and only that last cell is read by single ranks.

Defined cases: a null text or one without words has size 0 and takes nothing; a source without words has target 0; an empty
table gives an empty mix; rows with the same id and text have one rank and enter together, as one unit of their joint words;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.operators.ordered import prefix_sums
from depotlens.sources.scratch import materialise

WEIGHTS = (5, 2, 1)
LIMIT = 3
CELLS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def _uniform(id_col: str, text_col: str) -> Column:
    """In (0, 1), from the id and the whole text: 48 bits of an MD5, centred in their step."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources may be many: they are ranked by range partitions, and each pass that shares the excess again only brings two
    sums to the driver.
    """
    sums = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = prefix_sums(sums.withColumn("_one", F.lit(1)), [F.col("source").isNull(), F.col("source")], {"_rank": F.col("_one")}, "source-ranks")
    ranked = materialise(ranked.select(
        "source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long").alias("_weight")),
        "source-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped, shared, weight = 0, total, ranked.agg(F.sum("_weight")).first()[0] or 1
    while True:
        # A source is full if its share of what the others leave is above its limit; full ones stay full.
        full = F.col("_weight") * F.lit(float(shared)) / F.lit(float(weight)) > limit * F.col("source_size")
        row = ranked.agg(
            F.sum(F.when(full, limit * F.col("source_size"))).alias("words"), F.sum(F.when(~full, F.col("_weight"))).alias("weight")).first()
        if row.weight is None or (row.words or 0) == capped and row.weight == weight:
            break
        capped, shared, weight = row.words or 0, total - (row.words or 0), row.weight
    share = F.col("_weight") * F.lit(float(shared)) / F.lit(float(weight))
    return ranked.select("source", "source_size", F.least(share, (limit * F.col("source_size")).cast("double")).alias("target"))


def _ranks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source's ``plan``, and ``_at``: their rank's odds as a number in [0, 1)."""
    plan = plan.withColumnRenamed("source", "_source")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("_at", F.when((F.col("_rest") > 0) & (F.col("size") > 0), odds / (1 + odds)))


def _reached(units: DataFrame, unit: str) -> DataFrame:
    """The first ``unit`` of each source at which the rest is reached, and the words ``_done`` before it."""
    before = W.partitionBy("source").orderBy(unit).rowsBetween(W.unboundedPreceding, -1)
    summed = units.withColumn("_before", F.col("_done") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    first = summed.where(F.col("_before") + F.col("words") >= F.col("_rest")).groupBy(F.col("source").alias("_source")).agg(
        F.min(F.struct(unit, "_before")).alias("_x"))
    return first.select("_source", F.col(f"_x.{unit}").alias("_stop"), F.col("_x._before").alias("_done"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _uniform(id_col, text_col).alias("_u"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per source of (doc_id, source, size, _u): its target, certain copies, sample odds, and which ranks enter.

    Ranks below ``_stop`` enter, and ``_extra`` as the last one: of the ranks from there on, the one whose words come
    nearest to what is still open (none if nothing comes nearer).
    """
    targets = source_targets(rows, weights, limit)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("_whole", F.least(F.floor(rate), F.lit(limit))).withColumn("_p", rate - F.floor(rate))
    rest = F.when(F.col("_p") > 0, F.col("target") - F.col("_whole") * F.col("source_size")).otherwise(F.lit(0.0))
    plan = materialise(plan.withColumn("_rest", rest), "mix-targets")
    sampled = materialise(_ranks(rows, plan).where("_at is not null").select("source", "size", "_rest", "_at"), "mix-ranks")
    stops = None
    for cells in (CELLS, CELLS * CELLS, None):  # ever finer parts of the ranks, each inside the last part reached
        unit = F.floor(F.col("_at") * cells) if cells else F.col("_at")
        inside = sampled.withColumn("_done", F.lit(0).cast("long"))
        if stops is not None:
            inside = sampled.join(stops, F.col("source").eqNullSafe(F.col("_source")) & (F.floor(F.col("_at") * last) == F.col("_stop")))
        units = inside.groupBy("source", "_rest", "_done", unit.alias("_unit")).agg(F.sum("size").alias("words"))
        stops, last = materialise(_reached(units, "_unit"), "mix-stops"), cells
    open_ = sampled.join(stops, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") >= F.col("_stop")))
    units = open_.groupBy("source", "_at", (F.col("_rest") - F.col("_done")).alias("_open")).agg(F.sum("size").alias("words"))
    off = F.abs(F.col("_open") - F.col("words"))
    extra = units.where(off < F.col("_open")).groupBy(F.col("source").alias("_extra_source")).agg(F.min(F.struct(off.alias("off"), "_at")).alias("_x"))
    with_stop = plan.join(stops, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "_done")
    with_extra = with_stop.join(extra, F.col("source").eqNullSafe(F.col("_extra_source")), "left")
    return materialise(with_extra.select(*plan.columns, "_stop", F.col("_x._at").alias("_extra")), "mix-plan")


def _copies() -> Column:
    # A rest above what all documents hold has no stop: then all of them enter.
    entered = F.when(F.col("_at").isNull(), F.lit(False)).otherwise(
        F.col("_stop").isNull() | (F.col("_at") < F.col("_stop")) | F.coalesce(F.col("_at") == F.col("_extra"), F.lit(False)))
    return (F.col("_whole") + entered.cast("int")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken words of every row."""
    rows = materialise(_rows(docs, id_col, text_col, source_col), "mix-sizes")
    placed = _ranks(rows, mix_plan(rows, **options)).withColumn("copies", _copies())
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as many times as it is taken."""
    rows = materialise(_rows(docs, id_col, text_col, source_col), "mix-sizes")
    plan = mix_plan(rows, **options)
    # Copies follow from the row and its source's plan alone, so texts only meet one row per source.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(whole, F.col(source_col).alias("source"), F.col(text_col).rlike(_WORD).cast("int").alias("size"), _uniform(id_col, text_col).alias("_u"))
    placed = _ranks(keyed, plan).withColumn("_copies", _copies()).where("_copies > 0")
    return placed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
