"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.sources.scratch import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least node around it: the greater ones (large), or the lesser and itself."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Here b < a for small stars; for large ones b runs over all neighbours of a.
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # Stored, so that both sides of the join are exchanged and a hot node's rows can be split.
    least = materialise(least, "least")
    joined = both.join(least, F.col("a") == F.col("n"))
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    own = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (columns a and b, any comparable type); the label is the least node.

    A hot node's neighbours are only combined by a minimum and joined back, never gathered. Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, seen = materialise(edges, "edges"), None
    while True:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == seen:
            break
        seen = (row.n, row.h)
        edges = materialise(_star(_star(edges, True), False), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
