"""Recall feed search and lot matching against documents and stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_lots, normalise_lot
from ..sources.scratch import materialise, setting
from . import ordered

MAX_RECALL_PAGE = 25

# Words of 64 bits over all lots of recalls; so many rows are broadcast at most, whatever the number of lots.
LOT_WORDS = 1 << 18


def recall_search(recalls: DataFrame, category: str = "", limit: int = 10, status: str = "ongoing") -> DataFrame:
    """Recalls by status and optional product phrase, newest first."""
    if limit > MAX_RECALL_PAGE:
        raise ValueError(f"limit must be at most {MAX_RECALL_PAGE}")
    rows = recalls.where(F.lower("status") == status.lower())
    if category:
        rows = rows.where(F.contains(F.lower("product"), F.lit(category.lower())))
    return ordered.top_k(rows, [F.desc("recall_date"), F.asc("recall_number")], limit)


def recall_lots(recalls: DataFrame, status: str = "ongoing") -> DataFrame:
    """One row per (recall, lot code) out of the free lot text of recalls with a status."""
    return (
        recalls.where(F.lower("status") == status.lower())
        .select("recall_number", "classification", F.explode(extract_lots("lot_numbers")).alias("lot"))
        .distinct()
    )


def _bits_of(lot: str) -> tuple[Column, Column]:
    """The word of a lot, and its three bits there."""
    code = F.xxhash64(lot)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(code, at).bitwiseAND(63).cast("int")) for at in (18, 24, 30)]
    return code.bitwiseAND(LOT_WORDS - 1), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def marked_lots(documents: DataFrame, lots: DataFrame, lot: str = "_lot") -> DataFrame:
    """``documents`` with ``_maybe``: false says for certain that no row of ``lots`` has their ``_lot``.

    The lots are too many to be broadcast, their bits (a Bloom filter in words) are not. So a join by lot need not move the documents
    that it would not find; true only says that a document has to go there.
    """
    word, bits = _bits_of(lot)
    words = lots.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_set"))
    word, bits = _bits_of("_lot")
    found = documents.withColumn("_at", word).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    maybe = F.col("_lot").isNotNull() & F.coalesce(F.col("_set").bitwiseAND(bits) == bits, F.lit(False))
    return found.withColumn("_maybe", maybe).drop("_at", "_word", "_set")


def recall_match(recalls: DataFrame, documents: DataFrame, status: str = "ongoing") -> DataFrame:
    """Documents whose lot is named by an ongoing recall, one row per (document, recall)."""
    lots = recall_lots(recalls, status).select(
        F.col("lot").alias("_lot"), F.col("recall_number").alias("matched_recall"), "classification")
    shipped = marked_lots(documents.withColumn("_lot", normalise_lot("lot_number")), lots)
    return shipped.where("_maybe").drop("_maybe").join(lots, "_lot").drop("_lot")


def _matched_lots(recalls: DataFrame, status: str) -> DataFrame:
    """Lots to test membership against. They may repeat: a distinct on the join key would leave the
    join without an exchange of its own, and then AQE could not split a hot lot."""
    return recall_lots(recalls, status).select(F.col("lot").alias("_lot"))


def affected_documents(recalls: DataFrame, documents: DataFrame, status: str = "ongoing") -> DataFrame:
    lots = _matched_lots(recalls, status)
    shipped = marked_lots(documents.withColumn("_lot", normalise_lot("lot_number")), lots).where("_maybe").drop("_maybe")
    return shipped.join(lots, "_lot", "left_semi").drop("_lot")


def unaffected_documents(recalls: DataFrame, documents: DataFrame, status: str = "ongoing") -> DataFrame:
    shipped = documents.withColumn("_lot", normalise_lot("lot_number"))
    return shipped.join(_matched_lots(recalls, status), "_lot", "left_anti").drop("_lot")


GRAM = 3


def _grams(text: str, sizes) -> Column:
    """The distinct runs of ``sizes`` characters of a text."""
    def of(size):
        last = F.char_length(text) - size + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(F.col(text), k, F.lit(size)))).otherwise(F.array())

    return F.array_distinct(F.concat(*map(of, sizes)))


def phrase_hits(phrases: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows of ``phrases`` (vendor, phrase, …) with the ``product`` names of the vendor that contain the phrase, both lower-cased.

    A product that contains a phrase holds each of its runs of ``GRAM`` characters. Each phrase is joined on the run that fewest of
    its vendor's products hold, and the hits are tested; so products of a vendor meet only phrases that share a rare run with them.
    Phrases shorter than ``GRAM`` are joined on the whole.

    The stored tables repeat themselves, so their files are a small part of the rows they hold, and Spark would broadcast them by the
    size of the files. The joins are merges therefore.
    """
    rows = catalogue.select("vendor", F.col("product"), F.lower("product").alias("_low"))
    places = materialise(rows.select("vendor", "product", "_low", F.explode(_grams("_low", range(1, GRAM + 1))).alias("_gram")), "grams")
    counts = places.groupBy("vendor", "_gram").agg(F.count("*").alias("_held"))
    numbered = materialise(phrases.withColumn("_id", F.monotonically_increasing_id()), "phrases")
    # A run is as long as the phrase where that is shorter, so the runs of that size alone are asked for.
    own = F.when(F.char_length("phrase") >= GRAM, _grams("phrase", [GRAM])).otherwise(F.array("phrase"))
    asked = numbered.select("_id", "vendor", F.explode(own).alias("_gram"))
    # A run that no product holds has no row here, and its phrase no hit: the number of runs found tells.
    found = asked.join(counts.hint("merge"), ["vendor", "_gram"])
    rarest = found.groupBy("_id").agg(F.min(F.struct("_held", "_gram")).alias("_r"), F.count("*").alias("_found"))
    keyed = numbered.withColumn("_runs", F.size(own)).join(rarest.hint("merge"), "_id").where("_found = _runs")
    keyed = keyed.withColumn("_gram", F.col("_r._gram")).drop("_r", "_found", "_runs", "_id")
    return keyed.join(places.hint("merge"), ["vendor", "_gram"]).where(F.contains("_low", "phrase")).drop("_gram", "_low")


def recall_candidates(recalls: DataFrame, documents: DataFrame, status: str = "ongoing") -> DataFrame:
    """Documents of a recalled vendor and product whose lot is not on the recall: a review list.

    The phrase test runs on the distinct (vendor, product) catalogue, not on documents; documents
    come back by an equi-join on the matching catalogue rows.
    """
    phrases = (
        recalls.where((F.lower("status") == status.lower()) & (F.length(F.trim("product")) > 0))
        .select(F.col("recall_number").alias("candidate_recall"), "vendor", F.lower(F.trim("product")).alias("phrase"),
                F.coalesce(extract_lots("lot_numbers"), F.array().cast("array<string>")).alias("_lots"))
    )
    catalogue = documents.select("vendor", F.col("product_name").alias("product")).distinct()
    hits = phrase_hits(phrases, catalogue).select(
        F.col("vendor").alias("_vendor"), F.col("product").alias("_product"), "candidate_recall", "_lots")
    return (
        documents.join(hits, (documents["vendor"] == hits["_vendor"]) & (documents["product_name"] == hits["_product"]))
        .where(~F.coalesce(F.array_contains("_lots", normalise_lot("lot_number")), F.lit(False)))
        .drop("_vendor", "_product", "_lots")
    )


def apply_quarantine(recalls: DataFrame, documents: DataFrame, status: str = "ongoing") -> DataFrame:
    """A new version of the document log with matched documents quarantined and flagged.

    The join side holds one row per lot, so documents are never multiplied.
    """
    lots = recall_lots(recalls, status).groupBy("lot").agg(F.min("recall_number").alias("_recall"))
    lots = ordered.rekeyed(lots, "lot", "_lot")
    return _quarantined(documents.withColumn("_lot", normalise_lot("lot_number")).join(lots, "_lot", "left")).drop("_lot", "_recall")


def _quarantined(documents: DataFrame) -> DataFrame:
    """Documents after the recall in ``_recall``, if any, was applied to them."""
    hit = F.col("_recall").isNotNull()
    flags = F.coalesce(F.col("flags"), F.array().cast("array<string>"))
    return documents.withColumns({
        "status": F.when(hit, "QUARANTINED").otherwise(F.col("status")),
        "flags": F.when(hit, F.array_union(F.array(F.lit("recall_match")), flags)).otherwise(flags),
        "recall_match": hit | F.coalesce(F.col("recall_match"), F.lit(False)),
        "recall_number": F.coalesce("_recall", "recall_number"),
    })


# Folders that a task writes at a time without sorting its rows. A split of a stored log holds 32 files at most, by the reader's default sizes.
OPEN_FOLDERS = "32"


def write_quarantine(recalls: DataFrame, path: str, status: str = "ongoing", part: str = "day") -> list:
    """Write the new version of a document log that is stored in folders by ``part``: only folders that hold a hit are replaced, whose list is returned.

    Rows that were quarantined before keep their recall and flags, so a second run writes the same folders again with the same rows.
    Rows whose lot no recall names are written where they are read, a file for a file; only the others move, to their lot and to their folder.
    """
    spark = recalls.sparkSession
    stored = spark.read.parquet(path)
    parts = [r[0] for r in affected_documents(recalls, stored, status).select(part).distinct().collect()]  # a row per folder
    known = [p for p in parts if p is not None]
    if parts:
        hit = F.col(part).isin(known) | F.col(part).isNull() if None in parts else F.col(part).isin(known)
        # Dynamic overwrite writes beside the folders and puts the new ones in their place once all is read.
        rows = marked_lots(stored.where(hit).withColumn("_lot", normalise_lot("lot_number")), _matched_lots(recalls, status))
        moved = apply_quarantine(recalls, rows.where("_maybe"), status).select(stored.columns).hint("rebalance", F.col(part))
        kept = _quarantined(rows.where("not _maybe").withColumn("_recall", F.lit(None).cast("string"))).select(stored.columns)
        with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FOLDERS):
            newer = moved.unionByName(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            newer.partitionBy(part).parquet(path)
    return sorted(known) + [None] * (None in parts)


def alert_with_recalled_stock(recalls: DataFrame, documents: DataFrame, inventory: DataFrame,
                              status: str = "ongoing") -> DataFrame:
    """Stock still on hand of each (vendor, product) that has a recalled shipment."""
    affected = (
        affected_documents(recalls, documents, status)
        .groupBy("vendor", "product_name").agg(F.count("*").alias("recalled_documents"))
    )
    stock = inventory.groupBy("vendor", "product_name").agg(
        F.count("*").alias("skus"), F.sum("qty_on_hand").alias("units_at_risk"))
    return stock.join(affected, ["vendor", "product_name"])
