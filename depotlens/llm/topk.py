"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are split into ``LISTS`` score lists; a score is the sum of its partial scores. Phase 1: every task takes, per
query, the k best entries of each of its lists, resolves those, and sends the k best scores it found. The k-th best of all
that were sent is a safe cutoff, since k rows reach it. Phase 2: the cutoff is broadcast, and a task collects every entry
whose partial score in some list is at least the cutoff divided by the number of lists; a row that reaches the cutoff has
one, because a sum cannot exceed its number of terms times the greatest term. Phase 3: the remaining partial scores of what
was collected are resolved, and the k best rows at or above the cutoff are sent and merged.

Queries are taken in blocks of ``BLOCK``, so what is broadcast has a fixed bound; vectors are never shuffled.

Scores are exact: components are whole numbers, multiplied as doubles while every product sum stays below 2^53 and as Python
integers beyond (then scores outside 64 bits stop at the ends of the range).

Defined cases: vectors that are null or hold null or non-finite components take no part; an empty vector scores 0 and a
shorter one is filled with 0; a null id is no query and comes last among ties; every query row is answered, repeated ones too,
and rows with a query's own id are not its candidates; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.operators.ordered import top_k_per
from depotlens.sources.scratch import materialise

LISTS = 4
BLOCK = 1024
ROWS = 512
_EXACT = float(1 << 53)


def quantised(vectors: list, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each component; None for vectors that take no part."""
    out = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
        out.append(np.floor(scale * x) if x is not None and np.isfinite(x).all() and np.isfinite(scale * x).all() else None)
    return out


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, :len(r)] = r
    return out


def _partials(rows: list[np.ndarray], queries: list[np.ndarray], lists: int) -> list[np.ndarray]:
    """One (rows, queries) array of partial scores per list."""
    width = max([1, *map(len, rows), *map(len, queries)])
    a, q = _matrix(rows, width), _matrix(queries, width)
    if np.abs(a).max(initial=0) * np.abs(q).max(initial=0) * width * lists >= _EXACT:
        whole = np.vectorize(int, otypes=[object])
        a, q = whole(a), whole(q)
    cuts = np.array_split(np.arange(width), min(lists, width))
    return [a[:, c] @ q[:, c].T for c in cuts]


def _batches(batches, scale: float):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = quantised(part.column("v").to_pylist(), scale)
            keep = [k for k, r in enumerate(rows) if r is not None]
            if keep:
                yield [part.column("id")[k].as_py() for k in keep], [rows[k] for k in keep]


def _blocks(queries: DataFrame, scale: float):
    """Queries on the driver, one block at a time."""
    block = []
    for row in queries.toLocalIterator():
        vector = quantised([row.v], scale)[0]
        if vector is not None:
            block.append((row.id, vector))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _own(ids: list, names: list) -> np.ndarray:
    """(rows, queries): is the row the query's own?"""
    number = {name: k for k, name in enumerate(dict.fromkeys(names))}
    mine = np.array([number.get(i, -1) for i in ids])
    return mine[:, None] == np.array([number[n] for n in names])[None]


_LONG = (-(1 << 63), (1 << 63) - 1)


def _long(x) -> int:
    return min(max(int(x), _LONG[0]), _LONG[1])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score) from rows (id, v) of both."""
    spark, answers = vectors.sparkSession, []
    kind = vectors.schema["id"].dataType.simpleString()
    for block in _blocks(queries, scale):
        names, points = [n for n, _ in block], [p for _, p in block]
        shared = spark.sparkContext.broadcast((names, points))

        def heads(batches, shared=shared):
            names, points = shared.value
            best = np.full((0, len(names)), -np.inf)
            for ids, rows in _batches(batches, scale):
                parts = _partials(rows, points, lists)
                own = _own(ids, names)
                seen = np.zeros(own.shape, bool)
                for p in parts:
                    open_ = np.where(own, -np.inf, p.astype(float))
                    take = min(k, len(ids))
                    top = np.argpartition(-open_, take - 1, axis=0)[:take]
                    np.put_along_axis(seen, top, True, axis=0)
                # Rounding down keeps the cutoff safe where scores are beyond exact doubles.
                total = sum(parts).astype(float)
                total = np.where(seen & ~own, np.where(np.abs(total) < _EXACT, total, np.nextafter(total, -np.inf)), -np.inf)
                best = -np.sort(-np.concatenate([best, total]), axis=0)[:k]
            at = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(at[1].astype(np.int64)), pa.array(best[at])], names=["q", "score"])

        found = vectors.mapInArrow(heads, "q long, score double")
        found = top_k_per(found, ["q"], [F.col("score").desc()], k).groupBy("q").agg(F.min("score").alias("cutoff"), F.count("*").alias("n"))
        cutoff = np.full(len(block), -np.inf)
        for row in found.where(F.col("n") == k).collect():  # at most one row per query of the block
            cutoff[row.q] = row.cutoff
        limits = spark.sparkContext.broadcast(cutoff)

        def resolve(batches, shared=shared, limits=limits):
            names, points = shared.value
            cut, best = limits.value, [[] for _ in names]
            for ids, rows in _batches(batches, scale):
                parts = _partials(rows, points, lists)
                share = cut / len(parts)
                near = np.zeros((len(ids), len(names)), bool)
                for p in parts:
                    near |= p.astype(float) >= np.nextafter(share, -np.inf)
                row, query = np.nonzero(near & ~_own(ids, names))
                total = sum(p[row, query] for p in parts)
                enough = total.astype(float) >= cut[query]
                row, query, total = row[enough], query[enough], total[enough]
                order = np.lexsort(([ids[r] is None for r in row], -total.astype(float), query)) if len(row) else []
                for n in order:
                    i = ids[row[n]]
                    best[query[n]].append((-int(total[n]), i is None, i if i is not None else 0, row[n]))
                for q in set(query.tolist()):
                    best[q] = sorted(best[q], key=lambda x: x[:3])[:k]
            rows = [(q, i if not none else None, _long(-s)) for q, found in enumerate(best) for s, none, i, _ in found]
            yield pa.RecordBatch.from_arrays([
                pa.array([q for q, _, _ in rows], pa.int64()), pa.array([names[q] for q, _, _ in rows], pa.from_numpy_dtype(np.int64)),
                pa.array([i for _, i, _ in rows], pa.int64()), pa.array([s for _, _, s in rows], pa.int64())], names=["q", "query_id", "vec_id", "score"])

        rows = vectors.mapInArrow(resolve, "q long, query_id long, vec_id long, score long")
        ranked = top_k_per(rows, ["q"], [F.col("score").desc(), F.col("vec_id").asc_nulls_last()], k)
        answers.append(materialise(ranked.select(F.col("query_id").cast(kind), F.col("rank").cast("int"), F.col("vec_id").cast(kind), "score"), "topk"))
    if not answers:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def nearest_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """The k best candidates of every row whose id is divisible by ``every``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return top_k(rows, rows.where(F.col("id") % every == 0), k)
