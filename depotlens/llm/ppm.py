"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes, with the number of times each byte followed each context in the
training texts. A byte is predicted from the longest context: seen n times with t different followers, a follower counted c
times has probability (2c - 1) / 2n, and t / 2n escapes to the context one byte shorter. There the followers of the longer
context are excluded: their counts leave n and their number leaves t. The last escape is to an even choice among the symbols
left. A text is its bytes with A-Z lower-cased, before it a start mark that only serves as context, after it an end symbol. So
the code lengths of all texts sum to a probability of at most 1.

Texts are stored once in chunks of about ``CHUNK_BYTES``. A chunk sends its different grams (context and byte) with their
training counts, one packed row per part of the trie, to the part that owns the last three context bytes; a part holds all
statistics of its contexts of three bytes and more. Shorter contexts come from the counts of byte triples, at most 257^3 rows
whatever the input. A part scores every gram that any chunk sent and returns the values to each chunk, where they meet the
texts again. Words for the unigram base travel the same way. So nothing that grows with the corpus is broadcast, collected or
held by one task beyond its part; grams and words are combined per chunk before they are shuffled.

Defined cases: a null text is empty: its end symbol alone is scored; without training texts every symbol has probability
1/257, and the base is that of empty counts; a null id is scored like any other; repeated rows count as often as they occur;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.sources.scratch import materialise

from .arrow import mix
from .chunks import CHUNK_BYTES, grouped, pack, split_texts, store_chunks, unpack

ORDER = 5
MARK = 256  # the start as a context, the end as a symbol
SYMBOLS = 257
BITS = 9
OWNED = 3  # context bytes that name the part of a gram

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PARTS = "part long, chunk long, kind string, keys binary, counts binary"


def _low(order: int) -> np.uint64:
    """Mask of a gram's symbol and last ``order`` context bytes."""
    return np.uint64((1 << BITS * (order + 1)) - 1)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every symbol (``ORDER`` context bytes and the symbol), and where each text starts."""
    sizes = np.array([len(t) + 1 for t in texts])
    pad, end = np.full(ORDER, MARK, np.uint16), np.full(1, MARK, np.uint16)
    symbols = np.concatenate([x for t in texts for x in (pad, np.frombuffer(t, np.uint8), end)]) if texts else pad
    n = len(symbols) - ORDER
    gram = symbols[:n].astype(np.uint64)
    for k in range(1, ORDER + 1):  # in place: a chunk's grams are the largest array of a task
        gram <<= np.uint64(BITS)
        gram |= symbols[k:n + k]
    own = np.ones(len(symbols), bool)
    starts = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    own[(starts[:, None] + np.arange(ORDER)).reshape(-1).astype(np.int64)] = False
    return gram[own[ORDER:]], np.cumsum(sizes) - sizes


def _sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


class Order:
    """Followers of all contexts of one length: ``keys`` (context and symbol), ``counts``, and per context n, t."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        context = keys >> np.uint64(BITS)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.contexts, self.first = context[first], first
        self.n = np.add.reduceat(counts, first) if len(keys) else np.zeros(0, np.int64)
        self.t = np.diff(np.r_[first, len(keys)])
        self.excluded = np.zeros(len(first), np.int64)  # what this order's followers count one order below

    def exclude_in(self, lower: "Order", order: int) -> None:
        at, found = _find(lower.keys, self.keys & _low(order - 1))
        below = np.where(found, lower.counts[at] if len(lower.counts) else 0, 0)
        if len(self.first):
            self.excluded = np.add.reduceat(below, self.first)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, wanted), max(0, len(sorted_) - 1))
    return at, (sorted_[at] == wanted) if len(sorted_) else np.zeros(len(wanted), bool)


def _reduced(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the grams with ``order`` context bytes, ascending."""
    short, where = np.unique(keys & _low(order), return_inverse=True)
    return short, np.bincount(where, counts, len(short)).astype(np.int64)


def trie(grams: np.ndarray, counts: np.ndarray, triples: tuple[np.ndarray, np.ndarray]) -> list[Order]:
    """All orders: the long ones from (ascending) grams with a count, the short ones from counts of byte triples."""
    orders = [Order(*_reduced(*triples, k)) for k in range(OWNED)]
    orders += [Order(*(_reduced(grams, counts, k) if k < ORDER else (grams, counts))) for k in range(OWNED, ORDER + 1)]
    for k in range(1, ORDER + 1):
        orders[k].exclude_in(orders[k - 1], k)
    return orders


def log_probabilities(orders: list[Order], grams: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's symbol after its context."""
    result, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    out_n, out_t = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for k in range(len(orders) - 1, -1, -1):
        o, keys = orders[k], grams & _low(k)
        at, known = _find(o.contexts, keys >> np.uint64(BITS))
        if not len(o.contexts):
            continue
        n, t = np.where(known, o.n[at] - out_n, 0), np.where(known, o.t[at] - out_t, 0)
        where, seen = _find(o.keys, keys)
        seen &= known & open_
        total = np.maximum(2 * n, 1).astype(float)
        result[seen] += np.log10((2 * o.counts[where][seen] - 1) / total[seen])
        open_ &= ~seen
        escape = open_ & known & (t > 0)
        result[escape] += np.log10(t[escape] / total[escape])
        out_n, out_t = np.where(known, o.excluded[at], 0), np.where(known, o.t[at], 0)
    result[open_] -= np.log10(np.maximum(SYMBOLS - out_t[open_], 1))
    return result


def _sent(chunks: DataFrame, parts: int) -> DataFrame:
    """What each chunk sends: its grams, its words, and (kind t, kept for the triples) its byte triples."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts = split_texts(row["sizes"], unpack(row["texts"]))
                train = np.array([bool(r["train"]) for r in row["rows"]], bool)
                gram, starts = grams_of(texts)
                learned = np.repeat(train, np.array(row["sizes"]) + 1)
                keys, (seen, n) = np.unique(gram), _sorted_counts(gram[learned])
                counts = np.zeros(len(keys), np.int64)
                counts[np.searchsorted(keys, seen)] = n
                out = [(-1, "t", pack(_reduced(seen, n, 2)[0]), pack(_reduced(seen, n, 2)[1]))]
                owner = mix((keys >> np.uint64(BITS)) & _low(OWNED - 1)) % np.uint64(parts)
                order = np.argsort(owner, kind="stable")
                for p, at in grouped(owner[order], order):
                    out.append((p, "g", pack(np.diff(keys[at], prepend=np.uint64(0))), pack(counts[at])))
                split = [t.split() for t in texts]
                words = Counter(w for own, x in zip(split, train) if x for w in own)
                others = {w for own, x in zip(split, train) if not x for w in own}
                names = sorted(others.union(words))
                owner = np.fromiter((zlib.crc32(w) % parts for w in names), np.int64, len(names))
                order = np.argsort(owner, kind="stable")
                for p, at in grouped(owner[order], order):
                    own = [names[i] for i in at]
                    out.append((p, "w", pack(b"\n".join(own)), pack(np.array([words.get(w, 0) for w in own], np.int64))))
                part, kind, keys_, counts_ = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    pa.array(part, pa.int64()), pa.array([row["chunk"]] * len(out), pa.int64()), pa.array(kind), pa.array(keys_, pa.binary()),
                    pa.array(counts_, pa.binary())], names=["part", "chunk", "kind", "keys", "counts"])

    return chunks.mapInArrow(send, _PARTS)


def _triples(sent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of two context bytes and a symbol; at most 257^3 rows come to the driver."""
    def count(batches):
        for batch in batches:
            keys = [unpack(x, "u8") for x in batch.column("keys").to_pylist()]
            counts = [unpack(x, "i8") for x in batch.column("counts").to_pylist()]
            key, n = _reduced(np.concatenate(keys), np.concatenate(counts), 2)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], names=["key", "n"])

    rows = sent.where("kind = 't'").select("keys", "counts").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.uint64), rows["n"].to_numpy(np.int64)


def _answers(sent: DataFrame, parts: int) -> DataFrame:
    """What each part returns to each chunk: log-probabilities (g) and training counts (w); per part its totals (s)."""
    shared = sent.sparkSession.sparkContext.broadcast(_triples(sent))

    def answer(table: pa.Table) -> pa.Table:
        out = []
        rows = [r for r in table.to_pylist() if r["kind"] == "g"]
        keys = [np.cumsum(unpack(r["keys"], "u8"), dtype=np.uint64) for r in rows]
        if rows:
            every, where = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.bincount(where, np.concatenate([unpack(r["counts"], "i8") for r in rows]), len(every)).astype(np.int64)
            value = log_probabilities(trie(every[counts > 0], counts[counts > 0], shared.value), every).astype(np.float32)
            at = 0
            for r, k in zip(rows, keys):
                out.append((r["part"], r["chunk"], "g", b"", pack(value[where[at:at + len(k)]])))
                at += len(k)
        rows = [r for r in table.to_pylist() if r["kind"] == "w"]
        words = [unpack(r["keys"]).split(b"\n") for r in rows]
        total: dict[bytes, int] = {}
        for r, own in zip(rows, words):
            for w, n in zip(own, unpack(r["counts"], "i8").tolist()):
                total[w] = total.get(w, 0) + n
        for r, own in zip(rows, words):
            out.append((r["part"], r["chunk"], "w", b"", pack(np.array([total[w] for w in own], np.int64))))
        if rows:
            out.append((rows[0]["part"], -1, "s", b"", pack(np.array([sum(total.values()), sum(n > 0 for n in total.values())], np.int64))))
        cols = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "chunk", "kind", "keys", "counts"])

    owned = sent.where("part >= 0").repartition(parts, "part")
    return owned.groupBy("part").applyInArrow(answer, _PARTS)


def ppm_scores(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``trains`` says which rows the model learns from, as an expression over ``docs``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), trains.alias("train"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    chunks = store_chunks(rows, lambda t: t.translate(_LOWER), chunk_bytes)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = materialise(_answers(materialise(_sent(chunks, parts), "lm-sent"), parts), "lm-answers")
    totals = [unpack(bytes(r.counts), "i8") for r in answers.where("kind = 's'").select("counts").toLocalIterator()]
    ends = chunks.agg(F.sum(F.expr("aggregate(rows, 0L, (a, x) -> a + IF(x.train, 1L, 0L))"))).first()[0] or 0
    n_train = sum(int(t[0]) for t in totals) + ends
    n_known = sum(int(t[1]) for t in totals) + (ends > 0)
    log_all = math.log10(n_train + 0.5 * (n_known + 1))
    schema = f"doc_id {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        given = {(r["kind"], r["part"]): r["counts"] for r in right.to_pylist()}
        for row in left.to_pylist():
            texts = split_texts(row["sizes"], unpack(row["texts"]))
            gram, starts = grams_of(texts)
            code, keys = pd.factorize(gram)
            owner = (mix((keys >> np.uint64(BITS)) & _low(OWNED - 1)) % np.uint64(parts)).astype(np.int64)
            value = np.empty(len(keys))
            order = np.lexsort((keys, owner))
            for p, at in grouped(owner[order], order):
                value[at] = unpack(given["g", p], "f4")
            scores = np.add.reduceat(value[code], starts)
            split = [t.split() for t in texts]
            names = sorted(set().union(*split))
            owner = np.fromiter((zlib.crc32(w) % parts for w in names), np.int64, len(names))
            count = np.zeros(len(names), np.int64)
            order = np.argsort(owner, kind="stable")
            for p, at in grouped(owner[order], order):
                count[at] = unpack(given["w", p], "i8")
            number = {w: k for k, w in enumerate(names)}
            logs, known = np.log10(count + 0.5), count > 0
            for r, words, s in zip(row["rows"], split, scores.tolist()):
                own = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                n = len(words) + 1
                base = float(logs[own].sum()) + math.log10(ends + 0.5) - n * log_all
                out.append((r["doc_id"], bool(r["train"]), n, int(known[own].sum()) + (ends > 0), n_train, base, s))
        cols = list(zip(*out)) if out else [[]] * 7
        types = [left.schema.field("rows").type.value_type.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    to_chunks = answers.where("kind <> 's'")
    return chunks.groupBy("chunk").cogroup(to_chunks.groupBy("chunk")).applyInArrow(score, schema)
