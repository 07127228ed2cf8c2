"""The registered queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    automaton_search, decontamination, html_extraction, mixing, near_dedup, piece_table, ppm, quality, sentence_dedup, suffix_dedup, token_files,
    topk, trie_pairs)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, number and checksum of every document's ids, read back from Huffman-coded files."""
    folder = token_files.write_documents(_table(spark, sf_dir, "documents"), tokenizer_file(), END_ID)
    return token_files.token_digests(spark, folder)


@_query
def op4_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op9_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover."""
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op4_pareto_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, list_value(5, 2, 1)[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source
), f AS (  -- how far sources are full, in the order in which they fill
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS shared, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weight
  FROM s WINDOW b AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT shared, weight FROM f WHERE w * shared::DOUBLE / weight::DOUBLE <= 3 * source_size ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(w * (SELECT shared FROM l)::DOUBLE / (SELECT weight FROM l)::DOUBLE, (3 * source_size)::DOUBLE) AS target FROM s
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t
), p AS (
  SELECT *, least(floor(rate), 3)::BIGINT AS whole, rate - floor(rate) AS p FROM r
), a AS (
  SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.whole, p.p, p.target - p.whole * p.source_size AS rest,
    CASE WHEN p.p > 0 AND d.size > 0 AND p.target - p.whole * p.source_size > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS pos
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), q AS (
  SELECT source, pos, rest, sum(size) AS words FROM a WHERE pos IS NOT NULL GROUP BY source, pos, rest
), c AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q
), stop AS (
  SELECT source, min(pos) AS stop, min(rest - before) AS open FROM c WHERE before + words >= rest AND before < rest GROUP BY source
), extra AS (
  SELECT c.source, arg_min(pos, (abs(open - words), pos)) AS extra FROM c JOIN stop ON c.source IS NOT DISTINCT FROM stop.source
  WHERE pos >= stop AND abs(open - words) < open GROUP BY c.source
)
SELECT a.doc_id, a.size, a.source_size, a.target,
  (a.whole + CASE WHEN a.pos IS NULL THEN 0 WHEN stop.stop IS NULL OR a.pos < stop.stop OR a.pos = extra.extra THEN 1 ELSE 0 END) * a.size AS taken
FROM a LEFT JOIN stop ON a.source IS NOT DISTINCT FROM stop.source LEFT JOIN extra ON a.source IS NOT DISTINCT FROM extra.source
"""

ORACLES["op9_fm_decontamination"] = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), dwin AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS k FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT r, k, dwin.n, item FROM dwin JOIN win USING (n, s)
), hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM hits) GROUP BY r
), items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


@_query
def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every query vector."""
    return topk.nearest_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op8_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.main_texts(_table(spark, sf_dir, "pages"))


@_query
def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated sentence spans."""
    return sentence_dedup.sentence_dedup(_table(spark, sf_dir, "documents"))


ORACLES["op7_threshold_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query
def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by prediction by partial matching, and its unigram base."""
    held_out = quality.fold("doc_id") == 1
    scored = ppm.ppm_scores(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op1_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that also start elsewhere."""
    return suffix_dedup.repeat_digests(_table(spark, sf_dir, "documents"))


@_query
def op11_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's SentencePiece ids, and the checksum of the text decoded from them."""
    return piece_table.piece_digests(_table(spark, sf_dir, "documents"), tokenizer_file(PIECES))


def _misspelt(doc_id, runs: Counter) -> Counter:
    """The runs of a document, of which one in 31, by checksum, has lost a letter."""
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        out[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += n
    return out


@_query
def op12_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word's near words, the form that it follows and the last form of the chain."""
    return trie_pairs.spelling_variants(trie_pairs.word_counts(_table(spark, sf_dir, "documents"), _misspelt))


@_query
def op13_automaton_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for every benchmark item."""
    return automaton_search.ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op13_automaton_scan"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), d AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0
), size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d
), asked AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS gain FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size
), scored AS (
  SELECT i, item_id, r, sum(times * gain * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // size.terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN d USING (r), size GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM scored JOIN d USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
