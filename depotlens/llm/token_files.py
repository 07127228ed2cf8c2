"""Token ids of whole documents in Huffman-coded files, in ascending order of document id.

Every text is encoded once and its ids are kept in the shared folder. Their counts over the whole table, at most one per
vocabulary entry, give one canonical length-limited Huffman code. Documents are dealt to range partitions by id (ties by
their ids' hash, so that many rows of one id still split) and each partition is written as one shard of independent blocks:
whole documents up to ``BLOCK_IDS`` ids, the bit stream, and a bit-offset checkpoint per ``LANE`` ids.

Layout of a token folder: ``blocks`` (shard, block, before = ids of the shard before it, doc_ids, n_ids per document, stream,
checkpoints) and ``code`` (id, count), from which a reader derives the code.

Defined cases: a null text is empty and has only the end id; a null document id comes first; rows with one document id follow
each other in an order fixed by their ids; an empty table makes a folder without blocks. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.sources.scratch import materialise, new_path

from .arrow import give_back, raw, slices
from .huffman import Code, decode

BLOCK_IDS = 1 << 16
SLICE_BYTES = 4 << 20
MOST_IDS = 1 << 24
BATCH_WORDS = 1 << 12
CACHED_WORDS = 300_000


def _among(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


# White space that texts are not cut at, or runs of it: such texts go to the tokenizer whole.
_ODD_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]")
_BLANK, _ODD_BYTE, _ODD_LEAD = _among(b" \n"), _among(b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"), _among(b"\xc2\xe1\xe2\xe3")  # in UTF-8
# Marks that are always cut off from an ASCII letter or digit before them (an apostrophe is not).
_MARK, _LETTER = _among(b".,!*$%&#|?:;"), _among(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class _Known:
    """Words and their ids in flat arrays: objects of Python would take several times as much, strewn between what is soon dropped."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words, self.ids, self.counts = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def add(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """``ids`` and ``counts`` are those of the words known before and of ``words``, and maybe more."""
        self.words = pa.concat_arrays([self.words, words])
        self.counts = counts[:len(self.words)].copy()
        self.ids = ids[:int(self.counts.sum(dtype=np.int64))].copy()


class TextEncoder:
    """A tokenizer that encodes each distinct word of a slice of texts once, and remembers words.

    A byte-level pre-tokenizer always cuts before a single space, around a line break and between a letter or digit and a closing mark,
    so texts without other white space are the sum of the words between such places. Everything else is encoded whole.
    New words after a space go to the tokenizer many at a time, as one text: it cuts between them, and an id stands for as many bytes as
    its name has characters, so that each word's ids are known by their bytes.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        kind = json.loads(definition)
        pre = kind.get("pre_tokenizer") or {}
        self.by_word = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = [t["content"] for t in kind.get("added_tokens", [])]
        self.known = _Known()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        self.widths[list(vocabulary.values())] = list(map(len, vocabulary))

    def _whole(self, x: np.ndarray, data: list[bytes], first: np.ndarray) -> np.ndarray:
        """The texts, ``x`` together, that are not cut; one beside another's blank may be among them."""
        if not self.by_word:
            return np.arange(len(data))
        odd, blank = _ODD_BYTE[x], _BLANK[x]
        odd[1:] |= blank[1:] & blank[:-1]
        text_of = lambda found: np.unique(np.searchsorted(first, np.flatnonzero(found), "right") - 1)
        whole = set(text_of(odd).tolist())
        whole.update(k for k in text_of(_ODD_LEAD[x]).tolist() if k not in whole and _ODD_SPACE.search(data[k].decode()))
        for mark in (s.encode() for s in self.special):
            whole.update(k for k, d in enumerate(data) if mark in d)
        return np.array(sorted(whole), np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        made = [own.ids for own in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int32, len(made))

    def _encoded_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same; all words are a space and what is no white space."""
        together = "".join(words)
        if not any(s in together for s in self.special):
            ids = np.array(self.tokenizer.encode_batch_fast([together], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.widths[np.minimum(ids, len(self.widths) - 1)])
            edges = np.cumsum([len(w.encode()) for w in words])
            at = np.searchsorted(ends, edges)
            if at[-1] == len(ids) - 1 and (ends[at] == edges).all():
                return ids, np.diff(at, prepend=-1).astype(np.int32)
        return self._encoded(words)  # a vocabulary that does not name all bytes, or a special token over an edge

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, one after the other, how many each has, and each of ``words``' place among them; up to ``CACHED_WORDS`` are remembered."""
        at = pc.index_in(words, value_set=self.known.words)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False).copy()
        if not len(new):
            return self.known.ids, self.known.counts, at
        fresh = words.take(pa.array(new))
        ids, counts, order = [self.known.ids], [self.known.counts], []
        texts = fresh.to_pylist()
        spaced = np.array([self.by_word and w[0] == " " and len(w) <= 64 and w.split() == [w[1:]] for w in texts])
        for encode, chosen in ((self._encoded_together, np.flatnonzero(spaced)), (self._encoded, np.flatnonzero(~spaced))):
            order.append(chosen)
            for low in range(0, len(chosen), BATCH_WORDS):
                own, n = encode([texts[k] for k in chosen[low:low + BATCH_WORDS].tolist()])
                ids.append(own)
                counts.append(n)
        order, held = np.concatenate(order), len(self.known.words)
        at[new[order]] = held + np.arange(len(order))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        room = order[:max(0, CACHED_WORDS - held)]
        room = room[:next((i for i, k in enumerate(room.tolist()) if len(texts[k]) > 64), len(room))]
        if len(room):
            self.known.add(fresh.take(pa.array(room)), ids, counts)
        return ids, counts, at

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return self.of_bytes([t.encode() for t in texts])

    def of_bytes(self, data: list[bytes]) -> list[np.ndarray]:
        """Ids of each text in UTF-8."""
        sizes = np.array([len(d) for d in data], np.int64)
        together, first = b"".join(data), np.cumsum(sizes) - sizes
        if not together:
            return [np.zeros(0, np.uint32) for _ in data]
        x = np.frombuffer(together, np.uint8)
        cut = x == 32
        cut[1:] |= (x[1:] == 10) != (x[:-1] == 10)
        cut[1:] |= _MARK[x[1:]] & _LETTER[x[:-1]]
        for k in self._whole(x, data, first).tolist():
            cut[first[k]:first[k] + sizes[k]] = False
        cut[first[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(x)].astype(np.int64)), pa.py_buffer(together)).dictionary_encode()
        ids, counts, at = self._words(words.dictionary)
        code = at[words.indices.to_numpy(zero_copy_only=False)]
        del cut, words  # what is not needed any more makes room
        n = counts[code]
        ends = np.cumsum(n, dtype=np.int32)  # a slice is far below 2^31 bytes, and so are its ids
        places = np.repeat((np.cumsum(counts, dtype=np.int32) - counts)[code] - (ends - n), n)
        places += np.arange(len(places), dtype=np.int32)
        flat = ids[places]
        edges = np.r_[0, ends][np.searchsorted(starts, np.r_[first, len(x)])]
        return [flat[a:b] for a, b in zip(edges, edges[1:])]


def _utf8(text: bytes) -> bytes:
    """``text`` with a replacement character for what is no UTF-8."""
    return text if text.isascii() else text.decode("utf-8", "replace").encode()


_encoders: dict[str, TextEncoder] = {}


def _encoder(definition: str) -> TextEncoder:
    """One per worker process."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = TextEncoder(definition)
        give_back()  # what reading the definition took
    return _encoders[definition]


def token_ids(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, tie): compressed ids of each text with ``end_id``; ``tie`` is a hash of the ids."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size is fixed

    def encode(batches):
        encoder, press = _encoder(shared.value), zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, ties = [], []
            for own in encoder.of_bytes([_utf8(t) for t in raw(batch.column("text"))]):
                own = np.append(own, np.uint32(end_id))
                own = own.astype("<u2").tobytes() + b"\2" if own.max() < 1 << 16 else own.astype("<u4").tobytes() + b"\4"
                ids.append(press.compress(own))
                ties.append(xxhash.xxh3_64_intdigest(own) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(ties, pa.int64())], names=["doc_id", "ids", "tie"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, f"doc_id {kind}, ids binary, tie long")


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    plain = [press.decompress(x) for x in column.to_pylist()]
    return [np.frombuffer(x, "<u2" if x[-1] == 2 else "<u4", (len(x) - 1) // x[-1]) for x in plain]


def _counts(ids: DataFrame) -> DataFrame:
    """(id, count) over all documents; each task sends one row per id that it has seen."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in slices(batches, "ids", SLICE_BYTES):
            here = np.concatenate(_unpacked(batch.column("ids")))
            if int(here.max(initial=0)) >= MOST_IDS:
                raise ValueError(f"ids must be below {MOST_IDS}")
            here = np.bincount(here)
            total = np.pad(total, (0, max(0, len(here) - len(total))))
            total[: len(here)] += here
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("count"))


def _code(counts: DataFrame) -> Code:
    """The code from its counts; at most one row per vocabulary entry, below ``MOST_IDS``, comes to the driver."""
    rows = counts.orderBy("id").toPandas()
    return Code(rows["id"].to_numpy(np.int64), rows["count"].to_numpy(np.int64))


def write_tokens(ids: DataFrame, folder: str) -> None:
    """Write (doc_id, ids, tie) as a token folder."""
    spark = ids.sparkSession
    _counts(ids).write.parquet(f"{folder}/code")
    shared = spark.sparkContext.broadcast(_code(spark.read.parquet(f"{folder}/code")))
    kind = ids.schema["doc_id"].dataType.simpleString()

    def blocks(batches):
        code, shard, number, before = shared.value, TaskContext.get().partitionId(), 0, 0
        kinds = {}

        def block(names, own):
            stream, checkpoints = code.encode(np.concatenate(own))
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int64()), pa.array([number], pa.int64()), pa.array([before], pa.int64()),
                pa.array([names], pa.list_(kinds["doc_id"])), pa.array([[len(x) for x in own]], pa.list_(pa.int64())),
                pa.array([stream], pa.binary()), pa.array([checkpoints], pa.binary()),
            ], names=["shard", "block", "before", "doc_ids", "n_ids", "stream", "checkpoints"])

        names, own, held = [], [], 0
        for batch in slices(batches, "ids", SLICE_BYTES):
            kinds["doc_id"] = batch.schema.field("doc_id").type
            for name, x in zip(batch.column("doc_id").to_pylist(), _unpacked(batch.column("ids"))):
                names.append(name)
                own.append(x.astype(np.int64))
                held += len(x)
                if held >= BLOCK_IDS:
                    yield block(names, own)
                    names, own, held, number, before = [], [], 0, number + 1, before + held
        if own:
            yield block(names, own)

    ordered = ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    ordered.select("doc_id", "ids").mapInArrow(
        blocks, f"shard long, block long, before long, doc_ids array<{kind}>, n_ids array<long>, stream binary, checkpoints binary",
    ).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def _read(spark: SparkSession, folder: str, columns: str, make) -> DataFrame:
    """Decode every block and give ``make`` the ids of each document; ``columns`` is the schema of what it returns."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    shared = spark.sparkContext.broadcast(_code(spark.read.parquet(f"{folder}/code")))
    # One row per shard, and so per partition, which bounds the window and the broadcast.
    shards = blocks.groupBy("shard").agg(F.sum(F.expr("aggregate(n_ids, 0L, (a, x) -> a + x)")).alias("_n"))
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_shard_start"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches) -> Iterator[pa.RecordBatch]:
        code = shared.value
        table = code.table()
        for batch in slices(batches, "stream", SLICE_BYTES // 4):
            sizes, names = batch.column("n_ids").to_pylist(), batch.column("doc_ids")
            ids = decode(list(zip(batch.column("stream").to_pylist(), batch.column("checkpoints").to_pylist(), map(sum, sizes))), table, code.bits)
            starts, docs = [], []
            for base, n, own in zip(batch.column("start").to_pylist(), sizes, ids):
                ends = np.cumsum(n)
                starts.extend((base + ends - n).tolist())
                docs.extend(np.split(own, ends[:-1]))
            names_flat = names.flatten()
            yield pa.RecordBatch.from_arrays([names_flat, pa.array(starts, pa.int64()), *make(docs)], schema=pa.schema(
                [("doc_id", names_flat.type), ("start", pa.int64()), *make.fields]))

    joined = blocks.join(F.broadcast(shards), "shard").select("doc_ids", "n_ids", "stream", "checkpoints", (F.col("before") + F.col("_shard_start")).alias("start"))
    return joined.mapInArrow(documents, f"doc_id {kind}, start long, {columns}")


def _as_ids(docs: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([x.astype("<u4").tobytes() for x in docs], pa.binary())]


def _as_digest(docs: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([len(x) for x in docs], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in docs], pa.int64())]


_as_ids.fields = [("ids", pa.binary())]
_as_digest.fields = [("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): ids as little-endian unsigned 32-bit integers."""
    return _read(spark, folder, "ids binary", _as_ids)


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in a token folder."""
    return _read(spark, folder, "n_tokens long, ids_crc32 long", _as_digest)


def write_documents(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None, **columns) -> str:
    """Encode and write whole documents; the token folder is returned."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    write_tokens(materialise(token_ids(docs, tokenizer_file, end_id, **columns), "token-ids"), folder)
    return folder
