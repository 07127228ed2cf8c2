"""Ranked lexical search by scanning documents with an automaton of all query terms.

Nothing is indexed: the distinct terms of the items, each between two guards, form an Aho-Corasick automaton that every task runs over
whole texts, in which each character that no term can hold has become a guard. So terms are met as whole words, at any length, and
the automaton's outputs, counted per document, are the term frequencies.

One pass stores (doc_id, number of terms, terms met and how often) of every document with a term: some bytes for each different
query term that a document holds. Sums over it give the number of documents, of terms and of documents per query term. A second pass, over
the stored rows, adds up scores per item and keeps ``k`` documents per item and task, which a last step ranks. A term of many items is
counted once, then mapped to its items.

Items come in blocks of at most ``BLOCK_BYTES`` of terms and ``BLOCK_ITEMS`` items, in the order of their ids, and each block is a pass: this
bounds the automaton, the weights and what the driver holds. More items make more passes, not larger ones.

Score of a document for an item, in 64-bit integers: the sum over the item's terms, repeats included, of weight * (10^9 tf div
(1000 tf + 8 m)), where m = 25 + (75 n N) div L and weight = floor(1000 ln((2 N + 2) / (2 df + 1))).

Defined cases: a null or empty text has no term, whether document or item; an item without a term, or whose terms occur nowhere, has no
row; items of one id are ranked each on its own; documents of one id are ranked each, and equal scores go by ascending
doc_id (null first); fewer than ``k`` rows if fewer documents score above 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.operators.ordered import top_k_per
from depotlens.sources.scratch import materialise, new_path

from .arrow import raw, slices

TOP = 10
BLOCK_ITEMS = 4096
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 8 << 20
CELLS = 4_000_000

# Letters A-Z become lower case; what is neither an ASCII letter or digit nor a byte of a longer character becomes a guard.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_HALF = 1 << 26


def terms_of(text: bytes) -> list[str]:
    return text.translate(_PLAIN).decode("utf-8", "replace").split(" ")


def _item_blocks(items: DataFrame, item_id: str, text_col: str) -> Iterator[tuple[list, list[Counter]]]:
    """Ids of items and how often each holds its terms, in blocks of bounded size (or one item)."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text_col).alias("text")).orderBy("item_id", "text")
    ids, held, size = [], [], 0
    for row in rows.toLocalIterator():
        own = Counter(t for t in terms_of((row["text"] or "").encode()) if t)
        more = sum(len(t) for t in own)
        if ids and (len(ids) == BLOCK_ITEMS or size + more > BLOCK_BYTES):
            yield ids, held
            ids, held, size = [], [], 0
        ids.append(row["item_id"])
        held.append(own)
        size += more
    if ids:
        yield ids, held


_automata: dict[str, object] = {}


def _automaton(key: str, terms: list[str]):
    """The automaton of a block's terms, each between two guards: one per worker process, as long as its block lasts."""
    if key not in _automata:
        import ahocorasick
        _automata.clear()
        built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, term in enumerate(terms):
            built.add_word(f" {term} ", number)
        built.make_automaton()
        _automata[key] = built
    return _automata[key]


def _scanned(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term: how many it has, and which of the block's terms how often."""
    def scan(batches):
        key, known = shared.value
        built = _automaton(key, known)
        for batch in slices(batches, "text", SLICE_BYTES):
            keep, sizes, terms, counts = [], [], [], []
            for k, text in enumerate(raw(batch.column("text"))):
                text = text.translate(_PLAIN)
                n = len(text.split())
                if not n:
                    continue
                met = Counter(number for _, number in built.iter(f" {text.decode('utf-8', 'replace')} ")) if known else {}
                keep.append(k)
                sizes.append(n)
                terms.append(np.fromiter(met.keys(), np.int32, len(met)))
                counts.append(np.fromiter(met.values(), np.int64, len(met)))
            ends = pa.array(np.r_[0, np.cumsum([len(x) for x in terms])].astype(np.int32))
            flat = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((terms, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(flat[0])), pa.ListArray.from_arrays(ends, pa.array(flat[1]))], names=["doc_id", "n", "terms", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    scanned = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, n long, terms array<int>, tf array<long>")
    return materialise(scanned, "term-counts")


def _scored(met: DataFrame, ids: list, held: list[Counter], terms: list[str], k: int, schema: T.StructType) -> DataFrame:
    """The ``k`` best documents of each task for each item of the block."""
    spark = met.sparkSession
    size = met.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(terms), np.int64)
    for term, n in met.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row per term of the block
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    place = {t: at for at, t in enumerate(terms)}
    entries = sorted((place[t], item, times) for item, own in enumerate(held) for t, times in own.items())
    owner = np.array([e[0] for e in entries], np.int64)
    plan = spark.sparkContext.broadcast({
        "docs": size["docs"], "terms": size["terms"], "weight": weight, "starts": np.searchsorted(owner, np.arange(len(terms) + 1)),
        "items": np.array([e[1] for e in entries], np.int64), "times": np.array([e[2] for e in entries], np.int64), "ids": ids})

    def score(batches):
        p = plan.value
        n_items, starts = len(p["ids"]), p["starts"]
        best, worst = [[] for _ in range(n_items)], np.ones(n_items, np.int64)

        def keep(scores, docs):
            row, item = np.nonzero(scores >= worst)
            order = np.argsort(item, kind="stable")
            row, item = row[order], item[order]
            for found in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1) if len(item) else []:
                at, rows = int(item[found[0]]), row[found]
                values = scores[rows, at]
                if len(rows) > k:
                    cut = np.partition(values, len(rows) - k)[len(rows) - k]
                    rows, values = rows[values >= cut], values[values >= cut]
                new = [(-v, docs[r] is not None, docs[r]) for v, r in zip(values.tolist(), rows.tolist())]
                best[at] = sorted(best[at] + new, key=lambda e: (e[0], e[1], e[2] if e[1] else 0))[:k]
                if len(best[at]) == k:
                    worst[at] = -best[at][-1][0]

        for batch in batches:
            at_once = max(1, CELLS // n_items)
            for low in range(0, batch.num_rows, at_once):
                part = batch.slice(low, at_once)
                counts = np.diff(np.asarray(part.column("terms").offsets))
                term = part.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column("tf").flatten().to_numpy(zero_copy_only=False)
                m = 25 + 75 * part.column("n").to_numpy(zero_copy_only=False) * p["docs"] // p["terms"]
                row = np.repeat(np.arange(part.num_rows), counts)
                value = p["weight"][term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                scores = np.zeros((part.num_rows, n_items), np.int64)
                # Terms met are mapped to items some at a time; sums of halves stay exact in doubles.
                wide = starts[term + 1] - starts[term]
                turn = np.cumsum(wide) // CELLS
                for some in np.split(np.arange(len(term)), np.flatnonzero(np.diff(turn)) + 1) if len(term) else []:
                    n = wide[some]
                    ends = np.cumsum(n)
                    entry = np.arange(ends[-1]) + np.repeat(starts[term[some]] - (ends - n), n)
                    cell = np.repeat(row[some] * n_items, n) + p["items"][entry]
                    gain = np.repeat(value[some], n) * p["times"][entry]
                    sums = [np.bincount(cell, half, scores.size).astype(np.int64) for half in (gain // _HALF, gain % _HALF)]
                    scores += (sums[0] * _HALF + sums[1]).reshape(scores.shape)
                keep(scores, part.column("doc_id").to_pylist())
        rows = [(at, p["ids"][at], doc, -value) for at, found in enumerate(best) for value, _, doc in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return met.mapInArrow(score, schema)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                     item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    schema = T.StructType([
        T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[item_id].dataType),
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
    path = new_path(spark, "ranked")

    def ranked(found: DataFrame) -> DataFrame:
        top = top_k_per(found, ["item"], [F.desc("score"), F.asc_nulls_first("doc_id")], k)
        return top.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

    empty = ranked(spark.createDataFrame([], schema))
    empty.write.parquet(path)
    for ids, held in _item_blocks(items, item_id, item_text):
        terms = sorted({t for own in held for t in own})
        met = _scanned(docs, spark.sparkContext.broadcast((uuid.uuid4().hex, terms)), id_col, text_col)
        ranked(_scored(met, ids, held, terms, k, schema)).write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)
