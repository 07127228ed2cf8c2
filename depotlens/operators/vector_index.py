"""A vector index of inverted lists with product-quantised codes, and approximate top-k by table look-up with exact re-ranking.

The number of lists grows with the square root of the number of vectors. Centres come from k-means over a sample of ``FIT_A_LIST``
rows a list, code books from at most ``FIT_CODES`` rows; both samples are drawn by hash and every vector is indexed. A vector lies in
the ``copies`` lists whose centres are nearest: in data without clusters neighbours often have other nearest centres, and copies find them
for a few bytes each. An entry of a list is the item, its home list and ``parts`` bytes: the nearest code word of each piece of what the
centre leaves. Whole vectors are stored once, by home list.

A search gives each query ``nprobe`` lists, a fifth of all by default, and reads those folders only. Queries are packed per list and
meet the list's slices in an equi-join of packed rows, so neither queries nor vectors pass through the driver and a hot list is as
many rows as it has slices. Similarity is looked up: query times centre, plus one table entry per code byte. The best ``pool``
items of each query are then compared exactly. Scores are rounded to 6 places and ties fall to the lower id.

Vectors that are null, zero, of another size or hold something that is no finite number are in no list; such queries find nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialise, new_path
from . import ordered

LISTS_A_ROOT = 2.0
LEAST_LISTS = 16
COPIES = 5
PARTS = 16
WORDS = 256
FIT_A_LIST = 64
FIT_CODES = 1 << 15
SLICE_ROWS = 1 << 16
QUERY_ROWS = 512
POOL_A_RESULT = 20


def n_lists(rows: int) -> int:
    """Lists for a number of vectors."""
    return max(1, min(rows, max(LEAST_LISTS, math.ceil(LISTS_A_ROOT * math.sqrt(rows)))))


def default_probes(lists: int) -> int:
    return max(1, lists // 5)


def _usable(vector: str, size: int | None = None) -> Column:
    sized = F.size(vector) > 0 if size is None else F.size(vector) == size
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return sized & numbers & F.exists(vector, lambda x: x != 0)


def _unit(batch):
    """Vectors of an Arrow list column as rows of length 1."""
    import numpy as np
    x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sample(rows: DataFrame, item_id: str, total: int, wanted: int) -> DataFrame:
    """About ``wanted`` rows, chosen by a hash of their ids."""
    return rows if total <= wanted else rows.where(F.pmod(F.xxhash64(item_id), F.lit(1 << 30)) < int((1 << 30) * wanted / total))


def _code_books(points, parts: int, seed: int):
    """For each piece of the dimensions, code words that are near the pieces of ``points`` (k-means over a bounded sample)."""
    import numpy as np
    rng, books = np.random.default_rng(seed), []
    for piece in np.array_split(np.arange(points.shape[1]), parts):
        own = points[:, piece]
        words = own[rng.choice(len(own), min(WORDS, len(own)), replace=False)]
        for _ in range(6):
            near = _nearest(own, words)
            count = np.bincount(near, minlength=len(words))
            sums = np.stack([np.bincount(near, own[:, d], len(words)) for d in range(own.shape[1])], axis=1)
            words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
        books.append(words)
    return books


def _nearest(x, words):
    import numpy as np
    return np.argmin((words * words).sum(axis=1) - 2.0 * (x @ words.T), axis=1)


def build_index(corpus: DataFrame, path: str, item_id: str = "vec_id", vector: str = "embedding", lists: int | None = None, copies: int = COPIES,
                parts: int = PARTS, seed: int = 7) -> None:
    """Write an index of ``corpus`` to ``path``: lists of codes, vectors by home list, and the model."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = corpus.sparkSession
    rows = corpus.where(_usable(vector)).select(F.col(item_id).alias("item_id"), F.col(vector).cast("array<float>").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        raise ValueError("no usable vector")
    size, total = sizes[0]
    rows = rows.where(F.size("vector") == size)
    lists, parts = lists or n_lists(total), min(parts, size)
    length = F.sqrt(F.aggregate("vector", F.lit(0e0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    unit = F.transform("vector", lambda x: x.cast("double") / F.col("_length"))
    points = _sample(rows, "item_id", total, lists * FIT_A_LIST).withColumn("_length", length).select(array_to_vector(unit).alias("_point"))
    model = KMeans(k=lists, seed=seed, maxIter=8, initMode="random", featuresCol="_point").fit(points)
    centres = np.array([c.tolist() for c in model.clusterCenters()])
    fit = _sample(rows, "item_id", total, FIT_CODES).limit(2 * FIT_CODES).select("vector").toArrow().column("vector").combine_chunks()
    points = _unit(fit)
    books = _code_books(points - centres[_nearest(points, centres)], parts, seed)
    shared = spark.sparkContext.broadcast((centres, books))  # square root of the rows, and 256 words a part
    copies = min(copies, len(centres))

    def place(batches):
        import pyarrow as pa
        centres, books = shared.value
        edges = np.cumsum([b.shape[1] for b in books])[:-1]
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS // 8):
                part = batch.slice(low, SLICE_ROWS // 8)
                if not part.num_rows:
                    continue
                x = _unit(part.column("vector"))
                far = (centres * centres).sum(axis=1) - 2.0 * (x @ centres.T)
                near = np.argsort(far, axis=1, kind="stable")[:, :copies]
                lists_ = near.reshape(-1)
                left = np.repeat(x, copies, axis=0) - centres[lists_]
                codes = np.stack([_nearest(own, words) for own, words in zip(np.split(left, edges, axis=1), books)], axis=1).astype(np.uint8)
                source = np.repeat(np.arange(part.num_rows), copies)
                yield pa.RecordBatch.from_arrays([
                    pa.array(lists_.astype(np.int32)), part.column("item_id").take(pa.array(source)), pa.array(near[source, 0].astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(np.tile(np.arange(copies) == 0, part.num_rows))], names=["list_id", "item_id", "home", "code", "at_home"])

    kind = corpus.schema[item_id].dataType.simpleString()
    entries = materialise(rows.mapInArrow(place, f"list_id int, item_id {kind}, home int, code binary, at_home boolean"), "entries")
    dealt = entries.hint("rebalance", F.col("list_id")).sortWithinPartitions("list_id")
    dealt.mapInArrow(_pack, f"list_id int, items array<{kind}>, homes array<int>, codes binary").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
    homes = entries.where("at_home").select(F.col("item_id").alias("_item"), "home")
    stored = rows.join(homes, F.col("item_id").eqNullSafe(F.col("_item"))).select("home", "item_id", "vector")
    stored.hint("rebalance", F.col("home")).write.mode("overwrite").partitionBy("home").parquet(f"{path}/vectors")
    model_row = {"centres": centres.tolist(), "books": [b.tolist() for b in books], "rows": total}
    spark.createDataFrame([(json.dumps(model_row),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def _pack(batches):
    """Entries sorted by list as rows of at most ``SLICE_ROWS`` entries of one list."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("list_id").to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(lists)) + 1, len(lists)]
        for a, b in zip(edges, edges[1:]):
            for low in range(a, b, SLICE_ROWS):
                part = batch.slice(low, min(SLICE_ROWS, b - low))
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("list_id").slice(0, 1), pa.ListArray.from_arrays(ends, part.column("item_id")), pa.ListArray.from_arrays(ends, part.column("home")),
                    pa.array([b"".join(part.column("code").to_pylist())], pa.binary())], names=["list_id", "items", "homes", "codes"])


class VectorIndex:
    """An index as ``build_index`` wrote it."""

    def __init__(self, spark: SparkSession, path: str):
        import numpy as np
        model = json.loads(spark.read.parquet(f"{path}/model").first()[0])
        self.lists, self.vectors = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/vectors")
        self.centres, self.books, self.rows = np.array(model["centres"]), [np.array(b) for b in model["books"]], model["rows"]


def _asked(queries: DataFrame, shared, choose: Callable, query_id: str, vector: str, size: int) -> DataFrame:
    """(list_id, queries, vectors): at most ``QUERY_ROWS`` queries of each list that ``choose`` gives them, packed."""
    kind = queries.schema[query_id].dataType.simpleString()

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        centres = shared.value[0]
        for batch in batches:
            for low in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(low, QUERY_ROWS)
                if not part.num_rows:
                    continue
                unit = _unit(part.column("vector"))
                near = choose((centres * centres).sum(axis=1) - 2.0 * (unit @ centres.T))
                probe = near.reshape(-1)
                order, owner = np.argsort(probe, kind="stable"), np.repeat(np.arange(part.num_rows), near.shape[1])
                for own in np.split(order, np.flatnonzero(np.diff(probe[order])) + 1):
                    who = owner[own]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([probe[own[0]]], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(who)], pa.int32()), part.column("query_id").take(pa.array(who))),
                        pa.array([unit[who].tobytes()], pa.binary())], names=["list_id", "queries", "vectors"])

    usable = queries.where(_usable(vector, size)).select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    return materialise(usable.mapInArrow(pack, f"list_id int, queries array<{kind}>, vectors binary"), "asked")


def _looked_up(index: VectorIndex, asked: DataFrame, shared, pool: int) -> DataFrame:
    """(query_id, item_id, home, near): the ``pool`` best entries of each list slice for each query that probes it."""
    lists = index.lists.where(F.col("list_id").isin([r[0] for r in asked.select("list_id").distinct().collect()]))  # list numbers: as many as centres
    kinds = index.lists.schema["items"].dataType.elementType.simpleString(), asked.schema["queries"].dataType.elementType.simpleString()

    def look(batches):
        import numpy as np
        import pyarrow as pa
        centres, books = shared.value
        edges = np.cumsum([b.shape[1] for b in books])[:-1]
        for batch in batches:
            for k in range(batch.num_rows):
                items, homes, who = (batch.column(c)[k].values for c in ("items", "homes", "queries"))
                codes = np.frombuffer(batch.column("codes")[k].as_py(), np.uint8).reshape(len(items), -1)
                q = np.frombuffer(batch.column("vectors")[k].as_py(), np.float64).reshape(len(who), -1)
                near = np.repeat((q @ centres[batch.column("list_id")[k].as_py()])[:, None], len(items), axis=1)
                for at, (own, words) in enumerate(zip(np.split(q, edges, axis=1), books)):
                    near += (own @ words.T)[:, codes[:, at]]
                best = np.argpartition(-near, pool - 1, axis=1)[:, :pool] if len(items) > pool else np.tile(np.arange(len(items)), (len(who), 1))
                at = pa.array(best.reshape(-1))
                yield pa.RecordBatch.from_arrays([
                    who.take(pa.array(np.repeat(np.arange(len(who)), best.shape[1]))), items.take(at), homes.take(at),
                    pa.array(np.take_along_axis(near, best, axis=1).reshape(-1))], names=["query_id", "item_id", "home", "near"])

    met = lists.join(asked, "list_id").select("list_id", "items", "homes", "codes", "queries", "vectors")
    found = met.mapInArrow(look, f"query_id {kinds[1]}, item_id {kinds[0]}, home int, near double")
    # An item may lie in several of a query's lists.
    return found.groupBy("query_id", "item_id", "home").agg(F.max("near").alias("near"))


def index_topk(queries: DataFrame, index: VectorIndex, k: int = 10, nprobe: int | None = None, pool: int | None = None, query_id: str = "query_id",
               vector: str = "embedding") -> DataFrame:
    """Approximate cosine top-k: ``(query_id, item_id, similarity, rank)``."""
    lists = len(index.centres)
    nprobe, pool = min(lists, nprobe or default_probes(lists)), pool or POOL_A_RESULT * k
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.books))

    def choose(far):
        import numpy as np
        return np.argsort(far, axis=1, kind="stable")[:, :nprobe]

    asked = _asked(queries, shared, choose, query_id, vector, index.centres.shape[1])
    found = ordered.top_k_per(_looked_up(index, asked, shared, pool), ["query_id"], [F.desc("near"), F.asc("item_id")], pool, "_place")
    return _compared(queries, found, index, k, query_id, vector)


def _compared(queries: DataFrame, found: DataFrame, index: VectorIndex, k: int, query_id: str, vector: str) -> DataFrame:
    """The ``k`` best of the items ``found``, by their whole vectors."""
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0e0), lambda acc, x: acc + x)

    vectors = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("_q"))
    pairs = found.join(vectors, "query_id").join(index.vectors, ["home", "item_id"])
    cosine = F.round(dot("_q", "vector") / F.sqrt(dot("_q", "_q") * dot("vector", "vector")), 6)
    top = ordered.top_k_per(pairs.select("query_id", "item_id", cosine.alias("similarity")), ["query_id"], [F.desc("similarity"), F.asc("item_id")], k, "rank")
    return top.withColumn("rank", F.col("rank").cast("long"))
