"""An inverted index over passages, and BM25 top-k from it.

Passages are cut into words once, task by task, and become slices of about ``SLICE_BYTES`` of words. A slice holds the posting lists of its
words, so a frequent word's list is cut into as many pieces as there are slices. The lists of a slice are dealt to buckets by term, one
row per slice and bucket: sorted terms, the number of postings of each, the largest term frequency and the shortest passage among them
(which bound what a piece can add to a score), and the postings. Another row holds the slice's passages. No row stands for a word of a
passage, and nothing is shuffled by term.

A search reads the folders of its terms' buckets only and stores the lists of its terms. From the piece bounds follows the most that a passage of a slice can score for a
query. Each query's most promising slices are scored first; the k-th best score so found stops every slice that cannot
reach it, and the others are scored too, so results are those of a full scan.

Queries come in blocks bounded in queries and terms; a block's weights are the only thing that is broadcast. Scores are
rounded to 6 places before ranking and ties fall to the lower id. A query counts each of its terms once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import spaced_tokens, tokens
from ..sources.scratch import LARGE_ROWS, materialise, new_path
from . import ordered

SLICE_BYTES = 4 << 20
BLOCK_QUERIES = 512
BLOCK_TERMS = 8192
FIRST_SLICES = 16
BUCKETS = 64
CELLS = 4_000_000
_PASSAGES = -1  # the bucket of passage rows


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _index_schema(kind: T.DataType) -> T.StructType:
    ints = T.ArrayType(T.IntegerType())
    return T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("slice", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("n", ints), T.StructField("max_tf", ints), T.StructField("min_len", ints), T.StructField("postings", T.BinaryType()),
        T.StructField("ids", T.ArrayType(kind)), T.StructField("lens", ints)])


def index_rows(passages: DataFrame, buckets: int = BUCKETS, item_id: str = "chunk_id", text: str = "chunk", slice_bytes: int = SLICE_BYTES,
               load: int = 0) -> DataFrame:
    """The rows of an index of ``passages``. Passages without a word are left out; ``load`` keeps the slices of later additions apart."""
    schema = _index_schema(passages.schema[item_id].dataType)

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, number = to_arrow_schema(schema), load << 48 | TaskContext.get().partitionId() << 24

        def row(bucket, **lists):
            cells = [pa.array([bucket], pa.int32()), pa.array([number], pa.int64())]
            for f in list(arrow)[2:]:
                flat = lists.get(f.name)
                if flat is None or f.name == "postings":
                    cells.append(pa.array([flat], f.type))
                else:
                    flat = flat if isinstance(flat, pa.Array) else pa.array(flat, f.type.value_type)
                    cells.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            return pa.RecordBatch.from_arrays(cells, names=arrow.names)

        def sliced(held):
            # Words follow each other in one buffer, each with the space behind it, so their places are those after a space.
            whole, ends = b"".join(x for _, x, _ in held), np.concatenate([e for _, _, e in held])
            after = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32) + 1
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(after), [None, pa.py_buffer(np.r_[0, after].astype(np.int64)), pa.py_buffer(whole)])
            lens = np.diff(np.searchsorted(after, np.r_[0, np.cumsum(ends)], "right"))
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(len(lens)), lens)
            cell = np.sort(codes * len(lens) + rows)
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            cell, tf = cell[first], np.diff(np.r_[first, len(cell)])
            term, row_of = cell // len(lens), cell % len(lens)
            starts = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
            n, max_tf, min_len = np.diff(starts), np.maximum.reduceat(tf, starts[:-1]), np.minimum.reduceat(lens[row_of], starts[:-1])
            names = pc.utf8_rtrim(coded.dictionary.cast(pa.large_string()), " ").cast(pa.string())
            order = pc.array_sort_indices(names).to_numpy()
            place = np.array([_bucket(t, buckets) for t in names.to_pylist()]) if buckets > 1 else np.zeros(len(names), np.int64)
            yield row(_PASSAGES, ids=pa.concat_arrays([i for i, _, _ in held]), lens=lens)
            for bucket in np.unique(place):
                own = order[place[order] == bucket]
                at = np.arange(n[own].sum()) + np.repeat(starts[own] - np.cumsum(n[own]) + n[own], n[own])
                data = np.concatenate([row_of[at], tf[at]]).astype("<i4").tobytes()
                yield row(int(bucket), terms=names.take(pa.array(own)), n=n[own], max_tf=max_tf[own], min_len=min_len[own], postings=data)

        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.greater(pc.binary_length(batch.column(1)), 1), False))
            sizes = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
            ends, low = np.cumsum(sizes), 0
            while low < batch.num_rows:
                base = int(ends[low] - sizes[low])
                high = max(low + 1, int(np.searchsorted(ends, base + slice_bytes - size, "right")))
                own = batch.slice(low, high - low)
                held.append((own.column(0), b"".join(own.column(1).cast(pa.binary()).to_pylist()), sizes[low:high]))
                size += int(ends[high - 1]) - base
                if size >= slice_bytes or high < batch.num_rows:
                    yield from sliced(held)
                    held, size, number = [], 0, number + 1
                low = high
        if held:
            yield from sliced(held)

    words = passages.select(F.col(item_id), spaced_tokens(text).alias("_words"))
    return words.mapInArrow(cut, schema)


def write_index(passages: DataFrame, path: str, buckets: int = BUCKETS, **options) -> None:
    """Write the index of ``passages`` as a table in folders by bucket, or add to the one in ``path``."""
    spark, load = passages.sparkSession, 0
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        known = spark.read.parquet(path).where(F.col("bucket") == _PASSAGES).agg(F.max(F.shiftright("slice", 48))).first()[0]
        load = 0 if known is None else known + 1
    # As many rows to a row group as a slice has buckets: a group holds some slices' worth of bytes at most.
    groups = {"parquet.block.row.count.limit": str(buckets)}
    rows = materialise(index_rows(passages, buckets, load=load, **options), "index-rows", **groups)
    rows.hint("rebalance", F.col("bucket")).write.options(**groups).mode("append").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _query_blocks(queries: DataFrame, query_id: str, query_text: str, size: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Query ids and terms, in blocks bounded in queries and in distinct terms; a longer query forms a block of its own."""
    rows = queries.select(F.col(query_id), F.sort_array(F.array_distinct(tokens(query_text))))
    ids, terms, seen = [], [], set()
    for query, own in rows.toLocalIterator():
        if not own:
            continue
        if ids and (len(ids) == size or len(seen | set(own)) > BLOCK_TERMS):
            yield ids, terms
            ids, terms, seen = [], [], set()
        ids.append(query)
        terms.append(own)
        seen |= set(own)
    if ids:
        yield ids, terms


def pieces(index: DataFrame, vocabulary: list[str], buckets: int | None) -> DataFrame:
    """Index rows of the terms' buckets."""
    rows = index.where(F.col("bucket") != _PASSAGES)
    if buckets:
        rows = rows.where(F.col("bucket").isin(sorted({_bucket(t, buckets) for t in vocabulary})))
    return rows.select("slice", "terms", "n", "max_tf", "min_len", "postings")


def _picked(index: DataFrame, shared, buckets: int | None) -> DataFrame:
    """(slice, term, n, max_tf, min_len, postings): a row per slice and bucket, cut down to the block's terms, which are numbers now."""
    def pick(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(shared.value, pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                code = pc.index_in(batch.column("terms")[k].values, value_set=known)
                own = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                if not len(own):
                    continue
                n = batch.column("n")[k].values.to_numpy()
                cells = [batch.column("slice").slice(k, 1)]
                for values in (code.take(pa.array(own)), *(batch.column(c)[k].values.take(pa.array(own)) for c in ("n", "max_tf", "min_len"))):
                    cells.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), values.cast(pa.int32())))
                both, ends = np.frombuffer(batch.column("postings")[k].as_py(), "<i4").reshape(2, -1), np.cumsum(n)
                at = np.arange(n[own].sum()) + np.repeat(ends[own] - np.cumsum(n[own]), n[own])
                yield pa.RecordBatch.from_arrays([*cells, pa.array([both[:, at].tobytes()], pa.binary())],
                                                 names=["slice", "term", "n", "max_tf", "min_len", "postings"])

    rows = pieces(index, shared.value, buckets)
    return rows.mapInArrow(pick, "slice long, term array<int>, n array<int>, max_tf array<int>, min_len array<int>, postings binary")


def _bounds(headers: DataFrame, plan) -> DataFrame:
    """(slice, query, bound): the most that a passage of the slice can score for the query."""
    def bound(slice_):
        import numpy as np
        import pyarrow as pa

        p = plan.value
        flat = lambda c: np.concatenate([x.values.to_numpy() for x in slice_.column(c)])
        term, tf, low = flat("term").astype(np.int64), flat("max_tf"), flat("min_len")
        share = tf * (p["k1"] + 1.0) / (tf + p["k1"] * (1.0 - p["b"] + p["b"] * low / p["average"]))
        wide = np.diff(p["starts"])[term]
        entry = np.arange(wide.sum()) + np.repeat(p["starts"][term] - np.cumsum(wide) + wide, wide)
        most = np.bincount(p["query"][entry], np.repeat(share, wide) * p["idf"][entry], len(p["ids"]))
        found = np.flatnonzero(most > 0)
        return pa.table([pa.array(np.full(len(found), slice_.column("slice")[0].as_py())), pa.array(found.astype(np.int32)), pa.array(most[found])],
                        names=["slice", "query", "bound"])

    return headers.groupBy("slice").applyInArrow(bound, "slice long, query int, bound double")


def _scores(index: DataFrame, picked: DataFrame, plan, open_: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """The ``k`` best passages of every open (slice, query)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    asked = open_.groupBy("slice").agg(F.collect_list("query").alias("queries"))  # at most a block's queries
    own = index.where(F.col("bucket") == _PASSAGES).select("slice", "ids", "lens").join(asked, "slice")
    lists = picked.join(asked.select("slice"), "slice", "left_semi").select("slice", "term", "n", "postings")

    def score(passages, lists):
        import numpy as np
        import pyarrow as pa

        p, out = plan.value, []
        if not passages.num_rows or not lists.num_rows:
            return pa.table([pa.array([], f.type) for f in arrow], schema=arrow)
        lens = passages.column("lens")[0].values.to_numpy()
        items, wanted = passages.column("ids")[0].values, np.sort(passages.column("queries")[0].values.to_numpy())
        both = [np.frombuffer(x.as_py(), "<i4").reshape(2, -1) for x in lists.column("postings")]
        row, tf = (np.concatenate([x[k] for x in both]).astype(np.int64) for k in (0, 1))
        term = np.concatenate([np.repeat(t.values.to_numpy(), n.values.to_numpy()) for t, n in zip(lists.column("term"), lists.column("n"))]).astype(np.int64)
        share = tf * (p["k1"] + 1.0) / (tf + p["k1"] * (1.0 - p["b"] + p["b"] * lens[row] / p["average"]))
        for some in np.split(wanted, range(max(1, CELLS // len(lens)), len(wanted), max(1, CELLS // len(lens)))):
            local = np.full(len(p["ids"]), -1)
            local[some] = np.arange(len(some))
            # The block's (term, query) entries of these queries, by term.
            kept = np.flatnonzero(local[p["query"]] >= 0)
            starts = np.searchsorted(kept, p["starts"])
            wide = np.diff(starts)[term]
            total = np.zeros((len(lens), len(some)))
            turn = np.cumsum(wide) // CELLS
            for part in np.split(np.arange(len(term)), np.flatnonzero(np.diff(turn)) + 1):
                w = wide[part]
                entry = kept[np.arange(w.sum()) + np.repeat(starts[term[part]] - np.cumsum(w) + w, w)]
                cell = np.repeat(row[part] * len(some), w) + local[p["query"][entry]]
                total += np.bincount(cell, np.repeat(share[part], w) * p["idf"][entry], total.size).reshape(total.shape)
            total = np.round(total, 6)
            for at, query in enumerate(some.tolist()):
                values = total[:, at]
                rows = np.flatnonzero(values > 0)
                if len(rows) > k:
                    cut = np.partition(values[rows], len(rows) - k)[len(rows) - k]
                    rows = rows[values[rows] >= cut]
                best = sorted(zip((-values[rows]).tolist(), items.take(pa.array(rows)).to_pylist()))[:k]
                out += [(p["ids"][query], item, -value) for value, item in best]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(arrow), arrow)], schema=arrow)

    return own.groupBy("slice").cogroup(lists.groupBy("slice")).applyInArrow(score, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    top = ordered.top_k_per(found, ["query_id"], [F.desc("score"), F.asc("item_id")], k, "rank")
    return top.withColumn("rank", F.col("rank").cast("long"))


def open_slices(bounds: DataFrame, first: DataFrame, reached: DataFrame) -> DataFrame:
    """(slice, query) not scored first whose bound reaches the query's k-th best score so far (rounded, so one step of rounding is allowed)."""
    rest = bounds.join(first, ["slice", "query"], "left_anti").join(reached, "query", "left")
    return rest.where(F.col("reached").isNull() | (F.col("bound") + 1e-6 >= F.col("reached"))).select("slice", "query")


def search_index(queries: DataFrame, index: DataFrame, k: int = 5, buckets: int | None = BUCKETS, query_id: str = "query_id", query_text: str = "text",
                 k1: float = 1.2, b: float = 0.75, block: int = BLOCK_QUERIES) -> DataFrame:
    """BM25 top-k from an index: ``(query_id, item_id, score, rank)``. ``buckets`` is what the index was written with, or None without folders."""
    import numpy as np

    spark = index.sparkSession
    schema = T.StructType([
        T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("item_id", index.schema["ids"].dataType.elementType),
        T.StructField("score", T.DoubleType())])
    path, n = new_path(spark, "ranked"), None
    result = _best(spark.createDataFrame([], schema), k).schema
    spark.createDataFrame([], result).write.parquet(path)
    for ids, terms in _query_blocks(queries, query_id, query_text, block):
        if n is None:
            size = index.where(F.col("bucket") == _PASSAGES).agg(
                F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.sum(F.expr("aggregate(lens, 0L, (a, x) -> a + x)")).alias("words"),
                F.count("*").alias("slices")).first()
            n, words = size["n"], size["words"]
        if not n:
            break
        vocabulary = sorted({t for own in terms for t in own})
        picked = materialise(_picked(index, spark.sparkContext.broadcast(vocabulary), buckets), "picked", **LARGE_ROWS)
        df = np.zeros(len(vocabulary))
        for term, count in picked.select(F.inline(F.arrays_zip("term", "n"))).groupBy("term").agg(F.sum("n")).collect():  # a row per term of the block
            df[term] = count
        place = {t: at for at, t in enumerate(vocabulary)}
        entries = np.array(sorted((place[t], query) for query, own in enumerate(terms) for t in own), np.int64)
        plan = spark.sparkContext.broadcast({
            "ids": ids, "query": entries[:, 1], "starts": np.searchsorted(entries[:, 0], np.arange(len(vocabulary) + 1)),
            "idf": np.log(1.0 + (n - df + 0.5) / (df + 0.5))[entries[:, 0]], "average": words / n, "k1": k1, "b": b})
        bounds = _bounds(picked.select("slice", "term", "max_tf", "min_len"), plan)
        if size["slices"] <= FIRST_SLICES:
            found = _scores(index, picked, plan, bounds.select("slice", "query"), k, schema)
        else:
            bounds = materialise(bounds, "bounds")
            first = ordered.top_k_per(bounds, ["query"], [F.desc("bound"), F.asc("slice")], FIRST_SLICES).select("slice", "query")
            found = materialise(_scores(index, picked, plan, first, k, schema), "found")
            # At most k rows per query of the block.
            numbers = {row["query_id"]: row["score"] for row in _best(found, k).where(F.col("rank") == k).select("query_id", "score").collect()}
            reached = spark.createDataFrame([(at, numbers[q]) for at, q in enumerate(ids) if q in numbers], "query int, reached double")
            found = found.unionByName(_scores(index, picked, plan, open_slices(bounds, first, reached), k, schema))
        _best(found, k).write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)
