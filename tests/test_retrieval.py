"""Retrieval against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from depotlens.operators import lexical_index, retrieval, vector_index
from depotlens.sources.scratch import materialise, new_path


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 8))
    data[50] = data[51] = data[52]  # equal vectors: ties fall to the lower id
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(data)] + [(900, [0.0] * 8), (901, [1.0] * 3), (902, None), (903, [1.0, None] * 4)]
    return data, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).cache()


def brute(data, query, k):
    data = data.astype(np.float32).astype(float)
    sims = np.round(data @ query / np.sqrt((data ** 2).sum(axis=1) * (query ** 2).sum()), 6)
    return [(int(n), float(sims[n])) for n in sorted(range(len(data)), key=lambda n: (-sims[n], n))[:k]]


@pytest.mark.parametrize("block", [1, 3, 512])
def test_vector_topk(spark, vectors, block):
    data, corpus = vectors
    asked = [(n, [float(x) for x in data[n * 7 + 50]]) for n in range(11)]
    queries = spark.createDataFrame([*asked, (77, [0.0] * 8)], "query_id long, embedding array<double>")
    got = {}
    for r in retrieval.vector_topk(queries, corpus, 4, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, r.similarity))
    want = {n: brute(data, np.asarray(v), 4) for n, v in asked}
    assert {k: [x[0] for x in v] for k, v in got.items()} == {k: [x[0] for x in v] for k, v in want.items()}


def test_filtered_topk_honours_the_predicate(spark, vectors):
    data, corpus = vectors
    queries = spark.createDataFrame([(1, [float(x) for x in data[0]])], "query_id long, embedding array<double>")
    got = retrieval.filtered_vector_topk(queries, corpus, F.col("vec_id") >= 200, 5).orderBy("rank").collect()
    assert [r.item_id for r in got] == [n + 200 for n, _ in brute(data[200:], data[0], 5)]


def test_no_queries_or_no_corpus(spark, vectors):
    data, corpus = vectors
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert retrieval.vector_topk(none, corpus, 4).count() == 0
    one = spark.createDataFrame([(1, [float(x) for x in data[0]])], "query_id long, embedding array<double>")
    assert retrieval.vector_topk(one, corpus.limit(0), 4).count() == 0
    asked = spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert retrieval.lexical_topk(asked, spark.createDataFrame([], "chunk_id string, chunk string"), 4).count() == 0


def pairs(df):
    return {(r.query_id, r.item_id) for r in df.collect()}


@pytest.fixture(scope="module")
def vector_lists(spark, vectors):
    path = new_path(spark, "lists")
    vector_index.build_index(vectors[1].where(F.size("embedding") == 8), path)
    return path


def asked_vectors(spark, data):
    return spark.createDataFrame([(n, [float(x) for x in data[n]]) for n in range(0, 400, 10)], "query_id long, embedding array<double>")


def test_vector_index_finds_nine_tenths_in_a_fifth_of_the_lists(spark, vectors, vector_lists):
    data, corpus = vectors
    queries, index = asked_vectors(spark, data), vector_index.VectorIndex(spark, vector_lists)
    exact = retrieval.vector_topk(queries, corpus, 5)
    assert len(index.centres) == vector_index.n_lists(400) and 5 * vector_index.default_probes(len(index.centres)) <= len(index.centres)
    found = vector_index.index_topk(queries, index, 5)
    assert len(pairs(found) & pairs(exact)) >= 0.9 * exact.count()
    # Similarities are exact, and ranks follow them.
    known = {(r.query_id, r.item_id): r.similarity for r in exact.collect()}
    rows = found.orderBy("query_id", "rank").collect()
    assert all(known.get((r.query_id, r.item_id), r.similarity) == r.similarity for r in rows)
    assert all(a.similarity >= b.similarity for a, b in zip(rows, rows[1:]) if a.query_id == b.query_id)
    # Every list probed and every entry compared is exact.
    every = vector_index.index_topk(queries, index, 5, nprobe=len(index.centres), pool=400)
    assert pairs(every) == pairs(exact)


def test_only_probed_lists_are_read(spark, vectors, vector_lists):
    data, _ = vectors
    index = vector_index.VectorIndex(spark, vector_lists)
    one = asked_vectors(spark, data).limit(1)
    asked = vector_index._asked(one, spark.sparkContext.broadcast((index.centres, index.books)), lambda far: np.argsort(far, axis=1)[:, :3], "query_id", "embedding", 8)
    text = vector_index._looked_up(index, asked, spark.sparkContext.broadcast((index.centres, index.books)), 10)._jdf.queryExecution().executedPlan().toString()
    lists = re.search(r"PartitionFilters: \[[^\]]*list_id#\d+ (IN|INSET) \(?([\d, ]+)", text)
    assert lists and len(lists.group(2).split(",")) == 3


def test_every_usable_vector_is_indexed_once_at_home(spark, vectors, vector_lists):
    index = vector_index.VectorIndex(spark, vector_lists)
    assert index.rows == 400 and index.vectors.count() == 400
    entries = index.lists.select("list_id", F.explode("items").alias("item")).collect()
    assert len(entries) == len(set(entries)) == 400 * vector_index.COPIES


def test_lists_grow_with_the_rows():
    sizes = [vector_index.n_lists(n) for n in (1, 10, 100, 10_000, 1_000_000, 1_000_000_000)]
    assert sizes == [1, 10, 20, 200, 2000, 63246]


def test_vector_index_of_odd_rows(spark, vectors, vector_lists):
    index = vector_index.VectorIndex(spark, vector_lists)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.0] * 8), (4, [1.0] * 3), (5, [float("nan")] * 8), (6, [None] + [1.0] * 7)], "query_id long, embedding array<double>")
    assert vector_index.index_topk(odd, index, 5).count() == 0
    with pytest.raises(ValueError):
        vector_index.build_index(vectors[1].limit(0), new_path(spark, "empty"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{n}" for n in range(60)]
    passages = [(f"p{n:03}", " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randrange(1, 80)))) for n in range(300)]
    passages += [("p300", ""), ("p301", passages[0][1]), ("p302", "ÄPFEL Über w1!")]
    asked = [(n, " ".join(rng.choices(words, k=6)) + " unknown") for n in range(9)] + [(50, "über äpfel"), (51, "nothing here"), (52, "")]
    return passages, asked


def bm25(passages, query, k, k1=1.2, b=0.75):
    docs = {p: re.findall(r"[^\W_]+", t.lower()) for p, t in passages}
    docs = {p: t for p, t in docs.items() if t}
    average = sum(map(len, docs.values())) / len(docs)
    terms = set(re.findall(r"[^\W_]+", query.lower()))
    df = {t: sum(t in d for d in docs.values()) for t in terms}
    scores = {}
    for p, d in docs.items():
        tf = Counter(d)
        s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / average))
                for t in terms if tf[t])
        if round(s, 6) > 0:
            scores[p] = round(s, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("block", [1, 2, 512])
def test_lexical_topk(spark, texts, block):
    passages, asked = texts
    got = {}
    frame = retrieval.lexical_topk(spark.createDataFrame(asked, "query_id long, text string"),
                                   spark.createDataFrame(passages, "chunk_id string, chunk string").repartition(4), 5, block=block)
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, r.score))
    for n, text in asked:
        want = bm25(passages, text, 5)
        assert [x[0] for x in got.get(n, [])] == [x[0] for x in want]
        assert [x[1] for x in got.get(n, [])] == pytest.approx([x[1] for x in want], abs=2e-6)


@pytest.mark.parametrize("slice_bytes,first,cells", [(1 << 20, 4, 4_000_000), (1000, 1, 50), (130, 2, 7), (1, 3, 1000)])
def test_lexical_topk_in_any_slices(spark, texts, monkeypatch, slice_bytes, first, cells):
    passages, asked = texts
    monkeypatch.setattr(lexical_index, "FIRST_SLICES", first)
    monkeypatch.setattr(lexical_index, "CELLS", cells)
    rows = materialise(lexical_index.index_rows(spark.createDataFrame(passages, "chunk_id string, chunk string").repartition(3), 4, slice_bytes=slice_bytes), "rows")
    got = {}
    for r in lexical_index.search_index(spark.createDataFrame(asked, "query_id long, text string"), rows, 5, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, r.score))
    for n, text in asked:
        want = bm25(passages, text, 5)
        assert [x[0] for x in got.get(n, [])] == [x[0] for x in want]
        assert [x[1] for x in got.get(n, [])] == pytest.approx([x[1] for x in want], abs=2e-6)


def test_query_blocks_keep_every_query(spark):
    rows = [(n, " ".join(f"t{n}x{m}" for m in range(3000))) for n in range(7)] + [(9, " ".join(f"x{m}" for m in range(20_000))), (10, None), (11, " . ")]
    blocks = list(lexical_index._query_blocks(spark.createDataFrame(rows, "query_id long, text string"), "query_id", "text", 512))
    assert [q for ids, _ in blocks for q in ids] == [0, 1, 2, 3, 4, 5, 6, 9]
    assert all(len(ids) == 1 or sum(map(len, terms)) <= lexical_index.BLOCK_TERMS for ids, terms in blocks)


@pytest.fixture(scope="module")
def stored_index(spark, texts):
    path, rows = new_path(spark, "lexical"), spark.createDataFrame(texts[0], "chunk_id string, chunk string")
    lexical_index.write_index(rows.where("chunk_id < 'p100'"), path, 16, slice_bytes=1500)
    lexical_index.write_index(rows.where("chunk_id >= 'p100'"), path, 16, slice_bytes=1500)
    return path


def test_additions_to_a_stored_index(spark, texts, stored_index):
    passages, asked = texts
    index, queries = lexical_index.read_index(spark, stored_index), spark.createDataFrame(asked, "query_id long, text string")
    whole = retrieval.lexical_topk(queries, spark.createDataFrame(passages, "chunk_id string, chunk string"), 5)
    assert sorted(lexical_index.search_index(queries, index, 5, 16).collect()) == sorted(whole.collect())
    held = index.where("bucket = -1").select("slice", F.explode("ids").alias("id"))
    assert held.count() == 302 and held.groupBy("slice").count().count() == index.select("slice").distinct().count()


def test_only_buckets_of_query_terms_are_read(spark, stored_index):
    index = lexical_index.read_index(spark, stored_index)
    rows = lexical_index.pieces(index, ["w1", "w2"], 16)
    wanted = sorted({lexical_index._bucket(t, 16) for t in ("w1", "w2")})
    assert set(r.bucket for r in index.join(rows.select("slice", "terms"), ["slice", "terms"]).select("bucket").distinct().collect()) <= set(wanted)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(" + ",".join(map(str, wanted)), text)


def test_no_row_stands_for_a_word(spark, texts):
    passages = spark.createDataFrame(texts[0], "chunk_id string, chunk string").coalesce(1)
    rows = lexical_index.index_rows(passages, 8)
    assert rows.count() <= 9 and "Generate" not in rows._jdf.queryExecution().executedPlan().toString()


def _group_rows(df) -> list[int]:
    """Rows of each Parquet row group of a stored table."""
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in df.inputFiles()]
    return [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]


def _stored(monkeypatch, module) -> dict:
    """What a module materialises, by name."""
    seen, real = {}, module.materialise

    def watched(df, name, *args, **options):
        seen[name] = real(df, name, *args, **options)
        return seen[name]

    monkeypatch.setattr(module, "materialise", watched)
    return seen


def test_no_two_slices_share_a_row_group(spark, texts, monkeypatch):
    """A slice is megabytes in one row, and the reader holds a row group's rows at once."""
    passages, asked = texts
    monkeypatch.setattr(lexical_index, "SLICE_BYTES", 500)
    monkeypatch.setattr(lexical_index.index_rows, "__defaults__", tuple(500 if d == 4 << 20 else d for d in lexical_index.index_rows.__defaults__))
    indexes, picks = _stored(monkeypatch, retrieval), _stored(monkeypatch, lexical_index)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    retrieval.lexical_topk(queries, spark.createDataFrame(passages, "chunk_id string, chunk string").coalesce(1), 5).collect()
    for stored in (indexes["lexical-index"], picks["picked"]):
        groups = _group_rows(stored)
        assert len(groups) > 2 and set(groups) == {1}


def test_row_groups_of_a_written_index_hold_few_rows(spark, texts):
    path = new_path(spark, "grouped-index")
    lexical_index.write_index(spark.createDataFrame(texts[0], "chunk_id string, chunk string").coalesce(1), path, buckets=4, slice_bytes=500)
    groups = _group_rows(lexical_index.read_index(spark, path))
    assert sum(groups) > 8 and max(groups) <= 4


def test_slices_that_cannot_reach_the_top_are_not_scored(spark):
    """One slice holds all strong passages; after it was scored first, the bounds of the others stay below."""
    passages = [(f"a{n}", "rare rare rare word") for n in range(6)] + [(f"b{n}", "rare " + "filler " * 400) for n in range(60)] + [(f"c{n}", "word other") for n in range(50)]
    rows = materialise(lexical_index.index_rows(spark.createDataFrame(passages, "chunk_id string, chunk string").coalesce(1), 2, slice_bytes=120), "rows")
    vocabulary = ["rare"]
    picked = materialise(lexical_index._picked(rows, spark.sparkContext.broadcast(vocabulary), 2), "picked")
    plan = {"ids": [1], "query": np.array([0]), "starts": np.array([0, 1]), "idf": np.array([1.0]), "average": 200.0, "k1": 1.2, "b": 0.75}
    bounds = lexical_index._bounds(picked.select("slice", "term", "max_tf", "min_len"), spark.sparkContext.broadcast(plan))
    first = spark.createDataFrame([(r.slice, r["query"]) for r in bounds.orderBy(F.desc("bound")).limit(1).collect()], "slice long, query int")
    best = bounds.agg(F.max("bound")).first()[0]
    open_ = lexical_index.open_slices(bounds, first, spark.createDataFrame([(0, best - 1e-3)], "query int, reached double"))
    assert bounds.count() > 50 and open_.count() == 0
    # Without k results so far, or with bounds as good as the k-th best, nothing is left out.
    assert lexical_index.open_slices(bounds, first, spark.createDataFrame([], "query int, reached double")).count() == bounds.count() - 1


@pytest.mark.parametrize("size,overlap", [(500, 100), (10, 0), (10, 9), (7, 4), (1, 0)])
def test_chunks_cover_the_text(spark, size, overlap):
    texts = [(1, "".join(chr(97 + n % 26) for n in range(1234))), (2, "short"), (3, ""), (4, None), (5, "äöü\n🙂 line\n" * 9)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for r in retrieval.chunk_documents(df, size, overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.chunk))
    step = size - overlap
    for doc, text in texts:
        want = [(n + 1, text[n:n + size]) for n in range(0, len(text), step)] if text else []
        assert got.get(doc, []) == want


def test_hybrid_fusion(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, item_id long, rank long")
    lexical = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, item_id long, rank long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    rows = retrieval.hybrid_topk(queries, dense, lexical, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id, r.found) for r in rows] == [(1, 11, True), (1, 10, True), (2, 10, True), (3, None, False)]
    assert rows[0].rrf_score == round(1 / 62 + 1 / 61, 6)
