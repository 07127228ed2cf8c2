"""Queries over documents and embeddings.

Query vectors are the mean vectors of the labels, so they come from the whole table and their number
does not grow with it. Query texts are the benchmark items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical_index, retrieval, vector_index
from ..sources.scratch import materialise, new_path
from .registry import query


def prototypes(i):
    """One mean vector per label."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    points = i.table("embeddings").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    means = points.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m"))
    return means.select(F.col("label").cast("bigint").alias("query_id"), vector_to_array("m").alias("embedding"))


_PROTOTYPES = """
prototypes AS (
  SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY pos) AS q FROM (
    SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY label, pos)
  GROUP BY label)"""


def _cosine(source: str, extra: str = "") -> str:
    return f"""
sims AS (
  SELECT query_id, vec_id AS item_id, round(list_dot_product(q, e) / sqrt(list_dot_product(q, q) * list_dot_product(e, e)), 6) AS similarity
  FROM prototypes, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM {source}) {extra}),
dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM sims)"""


@query("vector_topk", f"WITH {_PROTOTYPES}, {_cosine('embeddings')} SELECT query_id, item_id, similarity, rank FROM dense WHERE rank <= 5")
def vector_topk(i):
    return retrieval.vector_topk(prototypes(i), i.table("embeddings"), 5)


_ENGLISH = "(SELECT e.* FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en')"


@query("filtered_vector_topk", f"WITH {_PROTOTYPES}, {_cosine(_ENGLISH)} SELECT query_id, item_id, similarity, rank FROM dense WHERE rank <= 5")
def filtered_vector_topk(i):
    """Only vectors whose document is in English."""
    meta = i.table("documents").select(F.col("doc_id").alias("vec_id"), "lang")
    corpus = i.table("embeddings").join(meta, "vec_id")
    return retrieval.filtered_vector_topk(prototypes(i), corpus, F.col("lang") == "en", 5)


_CHUNKS = """
chunks AS (
  SELECT doc_id, chunk_no, chunk_no * 400 + 1 AS start, doc_id || '-' || chunk_no AS chunk_id, substr(text, chunk_no * 400 + 1, 500) AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 399) // 400)) AS chunk_no FROM documents))"""


@query("chunk_documents", f"WITH {_CHUNKS} SELECT doc_id, chunk_no, start, chunk_id, chunk FROM chunks")
def chunk_documents(i):
    return retrieval.chunk_documents(i.table("documents"))


def _bm25(source: str, item: str, text: str, k: int) -> str:
    return f"""
words AS (SELECT {item} AS item_id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {source}),
lengths AS (SELECT item_id, count(*) AS len FROM words GROUP BY item_id),
size AS (SELECT count(*) AS n, avg(len) AS average FROM lengths),
terms AS (SELECT DISTINCT item_id AS query_id, term FROM (
  SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark)),
tf AS (SELECT item_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM terms) GROUP BY item_id, term),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM tf, size GROUP BY term, n),
scored AS (
  SELECT query_id, item_id, round(sum(idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / average))), 6) AS score
  FROM terms JOIN tf USING (term) JOIN idf USING (term) JOIN lengths USING (item_id), size GROUP BY query_id, item_id),
lexical AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored WHERE score > 0)
  WHERE rank <= {k})"""


def _asked(i):
    return i.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("lexical_topk", f"WITH {_CHUNKS}, {_bm25('chunks', 'chunk_id', 'chunk', 5)} SELECT query_id, item_id, score, rank FROM lexical")
def lexical_topk(i):
    return retrieval.lexical_topk(_asked(i), retrieval.chunk_documents(i.table("documents")), 5)


@query("hybrid_topk", f"""
WITH {_PROTOTYPES}, {_cosine('embeddings')}, {_bm25('documents', 'doc_id', 'text', 20)},
fused AS (
  SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.item_id, x.item_id) AS item_id, d.rank AS dense_rank, x.rank AS lexical_rank,
         round(coalesce(1e0 / (60 + d.rank), 0e0) + coalesce(1e0 / (60 + x.rank), 0e0), 6) AS rrf_score
  FROM (SELECT * FROM dense WHERE rank <= 20) d FULL JOIN lexical x ON d.query_id = x.query_id AND d.item_id = x.item_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, item_id) AS rank FROM fused)
SELECT b.item_id AS query_id, r.item_id, dense_rank, lexical_rank, rrf_score, rank, r.item_id IS NOT NULL AS found
FROM benchmark b LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.query_id = b.item_id""")
def hybrid_topk(i):
    """Benchmark texts against whole documents, fused with the label vector of the same number."""
    dense = retrieval.vector_topk(prototypes(i), i.table("embeddings"), 20)
    lexical = retrieval.lexical_topk(_asked(i), i.table("documents"), 20, item_id="doc_id", passage_text="text")
    return retrieval.hybrid_topk(_asked(i), dense, lexical, 5)


@query("retrieved_context", f"""
WITH {_CHUNKS}, {_bm25('chunks', 'chunk_id', 'chunk', 5)}
SELECT query_id, n_chunks, rank, item_id, chunk AS text FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_chunks FROM lexical)
JOIN chunks ON chunk_id = item_id""")
def retrieved_context(i):
    """The packed context per query, unpacked again to comparable rows."""
    chunks = materialise(retrieval.chunk_documents(i.table("documents")), "chunks")
    packed = retrieval.retrieved_context(retrieval.lexical_topk(_asked(i), chunks, 5), chunks)
    schema = "array<struct<rank: bigint, item_id: string, text: string>>"
    return packed.select("query_id", "n_chunks", F.explode(F.from_json("context", schema)).alias("r")).select("query_id", "n_chunks", "r.*")


@query("lexical_index_topk", f"WITH {_CHUNKS}, {_bm25('chunks', 'chunk_id', 'chunk', 5)} SELECT query_id, item_id, score, rank FROM lexical")
def lexical_index_topk(i):
    """The same ranking from a stored index that was written in two loads."""
    path, chunks = new_path(i.spark, "lexical-index"), retrieval.chunk_documents(i.table("documents"))
    lexical_index.write_index(chunks.where(F.col("doc_id") % 3 != 0), path)
    lexical_index.write_index(chunks.where(F.col("doc_id") % 3 == 0), path)
    return lexical_index.search_index(_asked(i), lexical_index.read_index(i.spark, path), 5)


@query("ivf_topk", f"""
WITH prototypes AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), {_cosine('embeddings')},
exact AS (SELECT query_id, item_id, similarity, rank FROM dense WHERE rank <= 10)
SELECT query_id, count(*) AS neighbours, max(similarity) FILTER (rank = 1) AS best, min(similarity) AS tenth,
  (SELECT count(*) >= 0.9e0 * count(*) FROM exact) AS enough FROM exact GROUP BY query_id""")
def ivf_topk(i):
    """What exact search finds for every fiftieth vector, and whether the index at its defaults finds nine tenths of it in a fifth of its lists."""
    vectors = i.table("embeddings")
    path = new_path(i.spark, "vector-index")
    vector_index.build_index(vectors, path)
    index = vector_index.VectorIndex(i.spark, path)
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index.index_topk(asked, index, 10)
    exact = retrieval.vector_topk(asked, vectors, 10)
    hits = exact.join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    per_query = materialise(hits.groupBy("query_id").agg(
        F.count("*").alias("neighbours"), F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("best"), F.min("similarity").alias("tenth"),
        F.count("hit").alias("_hits")), "recall")
    few = 5 * vector_index.default_probes(len(index.centres)) <= len(index.centres)
    enough = per_query.select(F.sum("_hits") >= 0.9e0 * F.sum("neighbours")).scalar()
    return per_query.select("query_id", "neighbours", "best", "tenth", (enough & F.lit(few)).alias("enough"))
