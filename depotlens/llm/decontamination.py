"""Benchmark decontamination with one FM-index per shard of documents.

A shard is a slice of a task's rows. Its texts become word ids; words outside the benchmark, and runs of known words too
short for any window, cannot be part of an occurrence and only separate runs. Every benchmark window is searched backwards
through wavelet ranks, its occurrences are located by sampled suffix positions, and their word spans are merged.

Documents are never shuffled. The benchmark is read in blocks of at most ``block_bytes`` of text, one pass each, so what is
broadcast has a fixed bound.

Defined cases: a null text has no words; a null benchmark text or one without words has no window; rows with the same item id
are one item, and a null item id reads as the empty string; empty tables give empty results or no hits; repeated document
rows are each reported; columns of ``docs`` not named in ``keep`` do not matter.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.sources.scratch import materialise

from .arrow import raw, slices, unused
from .fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 16 << 20

# A-Z become a-z; bytes that are not part of words become spaces. All bytes of a non-ASCII character are word bytes.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_FOUND = "spans array<struct<first:int,last:int>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _patterns(items: list[tuple[str, bytes]], window: int) -> dict:
    """Word ids of a block of items, and their distinct windows by length."""
    ids: dict[bytes, int] = {}
    windows: dict[int, dict[tuple[int, ...], set[int]]] = {}
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    for name, text in items:
        words = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(size, {}).setdefault(tuple(words[k:k + size]), set()).add(number[name])
    return {"ids": ids, "names": names, "windows": {
        size: (np.array(list(found), np.int64), [sorted(x) for x in found.values()]) for size, found in windows.items()}}


def _runs(known: np.ndarray, breaks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end index of the runs of known words of one document that hold ``least`` words or more."""
    edge = known.copy()
    edge[breaks[breaks < len(edge)]] = False  # a document's first word starts a run of its own
    starts = np.flatnonzero(known & ~np.r_[False, (known[:-1] & edge[1:])])
    if not len(starts):
        return starts, starts
    stops = np.flatnonzero(known & ~np.r_[(known[1:] & edge[1:]), False]) + 1
    long = stops - starts >= least
    return starts[long], stops[long]


def _shard(texts: list[bytes], block: dict) -> tuple[list[int], list[tuple[list[tuple[int, int]], list[str]]]]:
    """Number of words of each text; its merged word spans and item ids."""
    ids, counts, found = block["ids"], [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        found.append(np.fromiter(map(ids.get, words, repeat(0)), np.int32, len(words)))
    n_words = np.concatenate(found) if found else np.zeros(0, np.int32)
    empty = [([], []) for _ in texts]
    if not block["windows"] or not len(n_words):
        return counts, empty
    first_word = np.r_[0, np.cumsum(counts)]
    starts, stops = _runs(n_words > 0, first_word[:-1], min(block["windows"]))
    if not len(starts):
        return counts, empty
    lengths = stops - starts
    base = np.r_[0, np.cumsum(lengths + 1)]  # where each run starts in the index
    text = np.zeros(base[-1], np.int32)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    text[np.repeat(base[:-1], lengths) + inside] = n_words[np.repeat(starts, lengths) + inside]
    index = FMIndex(text, len(ids))
    hit, pairs = np.zeros(len(n_words) + 1, np.int64), []
    for size, (patterns, owners) in block["windows"].items():
        low, high = index.search(patterns)
        n_found = high - low
        which = np.flatnonzero(n_found)
        if not len(which):
            continue
        counted = n_found[which]
        rows = np.repeat(low[which], counted) + np.arange(int(counted.sum())) - np.repeat(np.cumsum(counted) - counted, counted)
        place = index.locate(rows)
        run = np.searchsorted(base, place, "right") - 1
        word = starts[run] + place - base[run]
        np.add.at(hit, word, 1)
        np.add.at(hit, word + size, -1)
        doc = np.searchsorted(first_word, word, "right") - 1
        pairs.append(np.unique(np.stack([doc, np.repeat(which, counted), np.full(len(doc), size)], 1), axis=0))
    if not pairs:
        return counts, empty
    covered = np.cumsum(hit[:-1]) > 0
    out = empty
    for doc, pattern, size in np.concatenate(pairs).tolist():
        out[doc][1].extend(block["names"][k] for k in block["windows"][size][1][pattern])
    for doc in {d for p in pairs for d in p[:, 0].tolist()}:
        own = covered[first_word[doc]:first_word[doc + 1]].astype(np.int8)
        edges = np.flatnonzero(np.diff(np.r_[0, own, 0]))
        out[doc][0].extend(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out[doc] = (out[doc][0], sorted(set(out[doc][1])))
    return counts, out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark on the driver, one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    for row in rows.where("t is not null").toLocalIterator():
        text = bytes(row.t)
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.i, text))
        size += len(text)
    if block:
        yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns ``keep`` of every row, then three more: number of words (null if there is no benchmark row), hit spans, items.

    Spans are merged runs of words; their ``last`` is exclusive. The three are named ``n_words``, ``spans`` and ``items``,
    with underscores before them where ``keep`` has such names.
    """
    spark = docs.sparkSession
    held, *names = unused(keep, "_text", "n_words", "spans", "items")
    held = text_col if text_col in keep else held
    found = docs.select(
        *keep, *([] if held in keep else [F.col(text_col).alias(held)]), F.lit(None).cast("long").alias(names[0]),
        F.from_json(F.lit("[]"), "array<struct<first:int,last:int>>").alias(names[1]), F.array().cast("array<string>").alias(names[2]))
    schema = found.schema
    for number, items in enumerate(_blocks(benchmark, item_col, item_text, block_bytes)):
        if number:  # each pass is written, so a lost executor repeats one pass and no task holds two blocks
            found = materialise(found, "benchmark-pass")
        shared = spark.sparkContext.broadcast(_patterns(items, window))

        def search(batches, shared=shared):
            block = shared.value
            for batch in slices(batches, held, shard_bytes):
                counts, new = _shard(raw(batch.column(held)), block)
                old = list(zip(batch.column(names[1]).to_pylist(), batch.column(names[2]).to_pylist()))
                spans = [_merged([(s["first"], s["last"]) for s in o] + x[0]) for (o, _), x in zip(old, new)]
                rows = [sorted({*o, *x[1]}) for (_, o), x in zip(old, new)]
                kind = batch.schema.field(names[1]).type
                cols = [batch.column(c) for c in batch.schema.names[:-3]]
                cols += [pa.array(counts, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], kind),
                         pa.array(rows, batch.schema.field(names[2]).type)]
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

        found = found.mapInArrow(search, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    return found if held in keep else found.drop(held)


def _remove(text: bytes, spans: list[dict]) -> bytes:
    """``text`` without the bytes from each span's first word to its last; a line break stands in their place."""
    mask = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 32
    edges = np.diff(np.r_[0, mask.astype(np.int8), 0])
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    parts, at = [], 0
    for s in spans:
        parts.append(text[at:first[s["first"]]])
        at = last[s["last"] - 1]
    return b"\n".join([*parts, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with benchmark spans cut out of their texts, until no window is left; other rows are unchanged.

    A cut puts words next to each other that stood apart, so cut texts are searched again; each round only looks at
    rows that the last one changed and shortens each of them, and a round that finds nothing ends the loop.
    """
    names = docs.columns
    changed, = unused(names, "_cut")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField(changed, T.BooleanType())])

    def cut(batches):
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            spans = batch.column(batch.num_columns - 2).to_pylist()
            new = [_remove(t, s) if s else t for t, s in zip(texts, spans)]
            cols = {n: batch.column(n) for n in names}
            cols[text_col] = pa.array(new, pa.binary()).cast(batch.schema.field(text_col).type)
            if length_col in names:
                old = batch.column(length_col).to_pylist()
                n_chars = [len(t.decode("utf-8", "replace")) if s else o for t, s, o in zip(new, spans, old)]
                cols[length_col] = pa.array(n_chars, batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array([bool(s) for s in spans])], names=[*names, changed])

    done, rest = None, docs
    while True:
        found = find_benchmark(rest, benchmark, names, text_col, **options)
        step = materialise(found.mapInArrow(cut, schema), "decontaminated")
        clean, rest = step.where(~F.col(changed)).drop(changed), step.where(changed).drop(changed)
        done = clean if done is None else done.unionByName(clean)
        if rest.isEmpty():
            return done


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: word and hit counts, items found, their digest."""
    found = find_benchmark(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, ["doc_id", "text"], **options)
    schema = "doc_id " + docs.schema[id_col].dataType.simpleString() + ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def digest(batches):
        for batch in slices(batches, "text", SHARD_BYTES):
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            counts = batch.column("n_words").to_pylist()
            if None in counts:
                counts = [len(words_of(t)) for t in raw(batch.column("text"))]
            hit = [sum(s["last"] - s["first"] for s in x) for x in spans]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(counts, pa.int64()),
                pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()),
                pa.array([h > 0 for h in hit]),
            ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(digest, schema)
