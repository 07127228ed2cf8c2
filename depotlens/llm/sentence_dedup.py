"""Substring dedup by sliding sentence spans.

Texts are cut into sentences: after ``. ! ?`` and white space, after their wide forms with or without it, and after line breaks. A span is a
run of consecutive sentences: every run of ``SENTENCES``, whatever their length, and every shorter run, the shortest from a sentence on or back
from it, with ``LONG_WORDS`` words, so that a passage of few long sentences counts as well.
Characters of scripts that do not part words count as a word each. So a passage of whole sentences that stands in two places, three of them or
``LONG_WORDS`` words, has spans that cover all of it. One that begins or ends inside a sentence is found by the whole sentences in it alone, and
stays if they make no span. Spans are compared by their sentences, with white space unified.

Every span has a hash of 128 bits, at which 10^12 spans meet by chance with a probability below 1e-14. Hashes that occur once are dropped by
counts alone; of the others the first occurrence, by document id, text and place, is kept, and all sentences that any other occurrence covers
are removed.

A hot span is counted and its first place found by combining aggregates, and joined back to its occurrences on a key that
Spark can split; no group is gathered. Spans to remove meet a document's text by the document's key.

Defined cases: a null text has no sentence and stays null; a text without a full span is unchanged; rows with the same id and
text count as one document and are treated alike; null ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.sources.scratch import materialise

from .arrow import slices

SENTENCES = 3
LONG_WORDS = 50
SLICE_BYTES = 4 << 20
_CUT = re.compile(r"(?:(?<=[.!?])\s+|(?<=[。！？])(?![.!?。！？」』”’）)])\s*|[^\S\n]*\n\s*)")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")  # kana and Han: words are not parted by white space


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence; an end includes the white space that follows."""
    ends = [m.end() for m in _CUT.finditer(text)]
    edges = [0, *ends, len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _wide_hash(data: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(data)
    return (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)


def spans(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Sentences of a text, and its spans as (two halves of the hash, first sentence, end)."""
    places = sentences(text)
    words = [text[a:b].split() for a, b in places]
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(w)) for w in words), "V16")
    wide = _WIDE.search(text) is not None
    total = np.r_[0, np.cumsum([max(len(w), len(_WIDE.findall(text, a, b)) if wide else 0) for w, (a, b) in zip(words, places)])].astype(np.int64)
    n = len(places)
    index = np.arange(n)
    # From a sentence on, the nearest end; back from a sentence, the nearest start.
    ends = np.maximum(np.searchsorted(total, total[:-1] + LONG_WORDS), index + 1)
    starts = np.minimum(np.searchsorted(total, total[1:] - LONG_WORDS, "right") - 1, index)
    runs = {(i, int(e)) for i, e in enumerate(ends) if e <= n} | {(int(s), i + 1) for i, s in enumerate(starts) if s >= 0}
    runs = {(a, b) for a, b in runs if b - a < SENTENCES} | {(i, i + SENTENCES) for i in range(n - SENTENCES + 1)}
    return places, [(*_wide_hash(hashes[a:b].tobytes()), a, b) for a, b in sorted(runs)]


def _spans_of(docs: DataFrame, kind: str) -> DataFrame:
    def cut(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            cols = [[], [], [], [], [], []]
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = spans(text)[1] if text else []
                key = xxhash.xxh3_64_intdigest(text or "") - (1 << 63)
                for c, values in zip(cols, ([x[0] for x in own], [x[1] for x in own], [name] * len(own), [key] * len(own), [x[2] for x in own], [x[3] for x in own])):
                    c.extend(values)
            types = [pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["h", "g", "doc_id", "tkey", "first", "end"])

    return docs.mapInArrow(cut, f"h long, g long, doc_id {kind}, tkey long, first int, end int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, first, end): spans of (doc_id, text) rows that are not the first occurrence of their sentences."""
    found = materialise(_spans_of(docs, docs.schema["doc_id"].dataType.simpleString()), "spans")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey", "first")
    many = materialise(found.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"), "span-hashes")
    again = materialise(found.join(many, ["h", "g"]), "repeated-spans")
    first = materialise(again.groupBy("h", "g").agg(F.min(place).alias("kept")), "first-spans")
    return again.join(first, ["h", "g"]).where(place != F.col("kept")).select("doc_id", "tkey", "first", "end")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, kept_text, n_sentences, removed): texts before and after; ``removed`` holds runs of sentences."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    # Repeated rows give the same spans: distinct() combines them before the shuffle.
    covered = repeated_spans(rows).distinct().groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    covered = materialise(covered, "covered").select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t"), "spans")
    keyed = _with_key(rows, kind)
    joined = keyed.join(covered, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_t")), "left").select("doc_id", "text", "spans")
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("kept_text", T.StringType()),
        T.StructField("n_sentences", T.LongType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def cut(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            kept, counts, removed = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                places = sentences(text) if text else []
                runs: list[list[int]] = []
                for s in sorted(own or [], key=lambda x: (x["first"], x["end"])):
                    if runs and s["first"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["end"])
                    else:
                        runs.append([s["first"], s["end"]])
                at, parts = 0, []
                for a, b in runs:
                    parts.append(text[at:places[a][0]])
                    at = places[b - 1][1]
                kept.append("".join([*parts, text[at:]]) if text else text)
                counts.append(len(places))
                removed.append(runs)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text"), pa.array(kept, batch.schema.field("text").type), pa.array(counts, pa.int64()),
                pa.array(removed, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "text", "kept_text", "n_sentences", "removed"])

    return joined.mapInArrow(cut, schema)


def _with_key(rows: DataFrame, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("tkey", T.LongType())])

    def key(batches):
        for batch in batches:
            keys = [xxhash.xxh3_64_intdigest(t or "") - (1 << 63) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "text", "tkey"])

    return rows.mapInArrow(key, schema)


def sentence_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, n_runs, kept_sha256) of every row."""
    rows = without_repeats(docs, id_col, text_col).select("doc_id", "kept_text", "n_sentences", "removed")
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_sentences", "n_removed", "n_runs")], T.StructField("kept_sha256", T.StringType())])

    def digest(batches):
        for batch in batches:
            removed = batch.column("removed").to_pylist()
            sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in batch.column("kept_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_sentences"), pa.array([sum(b - a for a, b in r) for r in removed], pa.int64()),
                pa.array([len(r) for r in removed], pa.int64()), pa.array(sha)], names=["doc_id", "n_sentences", "n_removed", "n_runs", "kept_sha256"])

    return rows.mapInArrow(digest, schema)
