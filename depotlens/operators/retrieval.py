"""Passage chunking, exact vector top-k, lexical and hybrid top-k, and packed context.

Vector scoring is a product of packed rows: queries are packed into stored rows of at most ``BLOCK_QUERIES``, the corpus into rows of
``BLOCK_VECTORS``, and every pair of rows of one dimension is one matrix product, all in one job. So queries stay off the driver, pairs are never rows, and
only k rows per query and packed row reach the final ranking. Lexical scoring goes through ``lexical_index``, approximate vector
search through ``vector_index``. Scores are rounded to 6 places before ranking and ties fall to the lower id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import LARGE_ROWS, materialise
from . import lexical_index, ordered

BLOCK_QUERIES = 512
BLOCK_VECTORS = 8192
RRF_OFFSET = 60


def chunk_documents(documents: DataFrame, size: int = 500, overlap: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Overlapping chunks ``(id, chunk_no, start, chunk_id, chunk)`` that cover each whole text.

    Texts are split into steps in one linear scan; the overlap is borrowed from the steps after.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    ahead = -(-overlap // step)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    split = documents.select(F.col(id_col), pieces.alias("_p"))
    if overlap:
        body = F.transform("_p", lambda piece, i: F.concat(
            piece, F.substring(F.array_join(F.slice("_p", i + 2, ahead), ""), 1, overlap)))
    else:
        body = F.col("_p")
    return (
        split.select(id_col, F.posexplode(body).alias("_i", "chunk"))
        .select(id_col, F.col("_i").cast("long").alias("chunk_no"), (F.col("_i") * step + 1).cast("long").alias("start"),
                F.concat_ws("-", F.col(id_col).cast("string"), F.col("_i").cast("string")).alias("chunk_id"), "chunk")
    )


def _packed(rows: DataFrame, id_col: str, vector: str, size: int) -> DataFrame:
    """(dimension, ids, vectors): vectors of one dimension, at most ``size`` a row, as 64-bit numbers.

    Rows whose vector is null, empty, zero, incomplete or not finite have no cosine with anything and are left out.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dimension in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dimension)
                for low in range(0, len(own), size):
                    part = batch.take(pa.array(own[low:low + size]))
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    length = (x * x).sum(axis=1)
                    real = np.flatnonzero((length > 0) & np.isfinite(length))
                    if len(real):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([dimension], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(real)], pa.int32()), part.column(0).take(pa.array(real))),
                            pa.array([(x[real] / np.sqrt(length[real])[:, None]).tobytes()], pa.binary())], names=["dimension", "ids", "vectors"])

    usable = rows.where(F.size(vector) > 0).select(F.col(id_col), F.col(vector).cast("array<double>"))
    return usable.mapInArrow(pack, f"dimension int, ids array<{kind}>, vectors binary")


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id", item_id: str = "vec_id",
                vector: str = "embedding", block: int = BLOCK_QUERIES) -> DataFrame:
    """Exact cosine top-k: ``(query_id, item_id, similarity, rank)``.

    Rows whose vector is null, zero, incomplete or of another size have no cosine with the query and drop out.
    """
    asked = materialise(_packed(queries, query_id, vector, block), "query-blocks")
    asked = asked.select("dimension", F.col("ids").alias("queries"), F.col("vectors").alias("asked"))
    # Few packed rows on either side, each pair one product. Stored blocks have a known size: small ones are broadcast by themselves, and
    # of many ones, AQE splits the rows of a dimension.
    met = _packed(corpus, item_id, vector, BLOCK_VECTORS).join(asked, "dimension")
    kinds = queries.schema[query_id].dataType.simpleString(), corpus.schema[item_id].dataType.simpleString()

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                items, asked = batch.column("ids")[row].values, batch.column("queries")[row].values
                x, q = (np.frombuffer(batch.column(c)[row].as_py(), np.float64).reshape(len(ids), -1) for c, ids in (("vectors", items), ("asked", asked)))
                similar = np.round(q @ x.T, 6)
                if len(items) > k:  # every item as good as the k-th best, so that ties are settled by id
                    cut = np.partition(similar, len(items) - k, axis=1)[:, len(items) - k]
                    query, item = np.nonzero(similar >= cut[:, None])
                else:
                    query, item = np.divmod(np.arange(similar.size), len(items))
                yield pa.RecordBatch.from_arrays([
                    asked.take(pa.array(query)), items.take(pa.array(item)), pa.array(similar[query, item])], names=["query_id", "item_id", "similarity"])

    found = met.select("ids", "vectors", "queries", "asked").mapInArrow(score, f"query_id {kinds[0]}, item_id {kinds[1]}, similarity double")
    top = ordered.top_k_per(found, ["query_id"], [F.desc("similarity"), F.asc("item_id")], k, "rank")
    return materialise(top.withColumn("rank", F.col("rank").cast("long")), "vector-hits")


def filtered_vector_topk(queries: DataFrame, corpus: DataFrame, predicate, k: int = 5, **names) -> DataFrame:
    """Vector top-k among corpus rows that satisfy a structured predicate, applied before scoring."""
    return vector_topk(queries, corpus.where(predicate), k, **names)


def lexical_topk(queries: DataFrame, passages: DataFrame, k: int = 5, query_id: str = "query_id",
                 query_text: str = "text", item_id: str = "chunk_id", passage_text: str = "chunk",
                 k1: float = 1.2, b: float = 0.75, block: int = lexical_index.BLOCK_QUERIES) -> DataFrame:
    """BM25 top-k over passages: ``(query_id, item_id, score, rank)``.

    The passages' index is made for this one search, without folders by term; a stored index answers later ones.
    """
    index = materialise(lexical_index.index_rows(passages, 1, item_id, passage_text), "lexical-index", **LARGE_ROWS)
    return lexical_index.search_index(queries, index, k, None, query_id, query_text, k1, b, block)


def hybrid_topk(queries: DataFrame, dense: DataFrame, lexical: DataFrame, k: int = 5, query_id: str = "query_id") -> DataFrame:
    """Reciprocal-rank fusion of two rankings; a query without any hit gives one row with ``found`` false."""
    d = dense.select("query_id", "item_id", F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "item_id", F.col("rank").alias("lexical_rank"))
    both = d.join(x, ["query_id", "item_id"], "full_outer")

    def share(rank):
        return F.coalesce(F.lit(1e0) / (F.lit(RRF_OFFSET) + F.col(rank)), F.lit(0e0))

    fused = both.withColumn("rrf_score", F.round(share("dense_rank") + share("lexical_rank"), 6))
    top = ordered.top_k_per(fused, ["query_id"], [F.desc("rrf_score"), F.asc("item_id")], k, "rank")
    everyone = queries.select(F.col(query_id).alias("query_id")).distinct()
    return everyone.join(top, "query_id", "left").select(
        "query_id", "item_id", "dense_rank", "lexical_rank", "rrf_score", F.col("rank").cast("long").alias("rank"),
        F.col("item_id").isNotNull().alias("found"))


def retrieved_context(hits: DataFrame, passages: DataFrame, item_id: str = "chunk_id", text: str = "chunk") -> DataFrame:
    """The hits' passages as one JSON array per query, best first. A group holds at most k rows.

    Hits are stored by the searches above, so their size is known and a short list is broadcast by itself.
    """
    rows = hits.join(passages.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), "item_id")
    entry = F.struct("rank", "item_id", "text")
    packed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    return packed.select("query_id", F.size("_all").cast("long").alias("n_chunks"), F.to_json("_all").alias("context"))
