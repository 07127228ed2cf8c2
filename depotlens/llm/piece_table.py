"""SentencePiece encoding and decoding through a table of distinct chunks.

In the models this works on no piece holds a white-space marker behind another character, so no merge crosses the place before a
marked word: the ids of a text are the ids of its marked words, one after the other. If no piece holds a line break and unknown
bytes fall back to byte pieces, line breaks are such places too. So texts are cut into chunks, each distinct chunk is segmented
once by the library, and its ids are joined back by position:

1. Each slice of about ``SLICE_BYTES`` of texts becomes one stored row: the chunks of its texts as numbers, most frequent ones first,
   and its distinct chunks, in alphabetical order among those about as frequent. Texts do not travel further.
2. A slice sends its distinct chunks to parts by hash. A part, sized by ``PART_BYTES`` from the whole amount, holds the distinct
   chunks of its range of hashes over the whole table, segments each once, and answers every slice.
3. Slices meet their answers, put ids in place of numbers, and decode the ids with the model's pieces. Bytes that are not
   UTF-8 and ids without a plain piece are decoded by the library.

A frequent word is one entry per slice whatever its occurrences, so no part is hot. A model with another normalizer, or with pieces
that cross markers, is refused.

Defined cases: a null text is empty; an empty text has no ids and decodes to the empty text; rows with one id or one text are
encoded each; a null id stays null; the marker character itself (U+2581) counts as a space, as in the library; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.sources.scratch import materialise

from .arrow import mix, raw, slices
from .chunks import unpack

SLICE_BYTES = 32 << 20
PART_BYTES = 8 << 20
BATCH_WORDS = 1 << 17
ROUND_WORDS = 1 << 20

_SPACE, _BREAK = 32, 10
_MARKER = "▁"
_WEIGHTS = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


class Model:
    """A SentencePiece model, where texts may be cut, and the bytes of its pieces."""

    def __init__(self, definition: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto.FromString(definition)
        rules, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = [p.piece for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
        if rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("the model normalizes texts")
        if proto.trainer_spec.treat_whitespace_as_suffix or any(_MARKER in p.lstrip(_MARKER) for p in plain):
            raise ValueError("pieces of the model cross white-space markers")
        self.processor = SentencePieceProcessor(model_proto=definition)
        self.at_breaks = proto.trainer_spec.byte_fallback and not any("\n" in p for p in plain)
        self.guard = "a\n" if self.at_breaks else "a"
        self.guarded = len(self.processor.encode(self.guard))
        size = self.processor.get_piece_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.odd = np.array([self.processor.is_control(k) or self.processor.is_unknown(k) for k in range(size)])
        self.pieces = pa.array([self._bytes(k) for k in range(size)], pa.binary())
        self.numbers = pa.array([b"%d," % k for k in range(size)], pa.binary())

    def _bytes(self, k: int) -> bytes:
        piece = self.processor.id_to_piece(k)
        return bytes([int(piece[1:-1], 16)]) if self.processor.is_byte(k) else piece.replace(_MARKER, " ").encode()

    def cut(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All texts in one buffer, each behind the space that the library puts before it; where chunks start, and how many each text has."""
        texts = [b" " + t.replace(_MARKER.encode(), b" ") if t else t for t in texts]
        whole = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        x = np.frombuffer(whole, np.uint8)
        starts = np.zeros(len(x), bool)
        space = x == _SPACE
        starts[1:] = space[1:] & ~space[:-1]
        if self.at_breaks:
            broken = x == _BREAK
            starts[1:] |= broken[1:] != broken[:-1]
        first = np.cumsum(sizes) - sizes
        starts[first[sizes > 0]] = True
        starts = np.flatnonzero(starts)
        return whole, starts, np.diff(np.searchsorted(starts, np.r_[first, len(x)]))

    def segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and how many each has."""
        found = self.processor.encode([self.guard + c.decode("utf-8", "replace") for c in chunks], num_threads=1)
        counts = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        keep = np.ones(len(flat), bool)
        before = np.cumsum(counts) - counts
        for k in range(self.guarded):
            keep[before + k] = False
        return flat[keep], counts - self.guarded

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts of documents of ``sizes`` ids each."""
        ends = np.cumsum(sizes)
        out = []
        for text, end, size in zip(_joined(self.pieces, ids, ends), ends.tolist(), sizes.tolist()):
            own = ids[end - size:end]
            text = text[1:] if text.startswith(b" ") else text
            if self.odd[own].any() or not _is_utf8(text):
                text = self.processor.decode(own.tolist()).encode()
            out.append(text)
        return out


def _is_utf8(text: bytes) -> bool:
    try:
        text.decode()
        return True
    except UnicodeDecodeError:
        return False


def _joined(table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The entries of ``ids`` in ``table`` put together, up to each of ``ends``."""
    taken = table.take(pa.array(ids.astype(np.int64)))
    if not len(ids):
        return [b""] * len(ends)
    offsets = np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1)
    whole, at = taken.buffers()[2], offsets[np.r_[0, ends]].tolist()
    return [whole[a:b].to_pybytes() for a, b in zip(at, at[1:])]


def pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


_models: dict[bytes, Model] = {}


def _model(definition: bytes) -> Model:
    """One per worker process."""
    if definition not in _models:
        _models.clear()
        _models[definition] = Model(definition)
    return _models[definition]


def _words(sizes: np.ndarray, whole: bytes) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(whole)])


def _layout(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """Sizes and bytes of an array of words."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1 + words.offset)[words.offset:]
    return np.diff(offsets), words.buffers()[2][int(offsets[0]):int(offsets[-1])].to_pybytes() if len(words) else b""


def _hashes(sizes: np.ndarray, whole: bytes) -> np.ndarray:
    """A 64-bit hash of each word, to deal words to parts."""
    ends = np.cumsum(sizes)
    place = np.arange(len(whole)) - np.repeat(ends - sizes, sizes)
    return mix(np.add.reduceat((np.frombuffer(whole, np.uint8).astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place & 4095], ends - sizes))


def _planes(x: np.ndarray) -> bytes:
    """Small numbers first in one byte, greater ones in the three planes behind."""
    rest = x[x >= 255] - 255
    planes = [np.minimum(x, 255), rest & 255, rest >> 8 & 255, rest >> 16 & 255, rest >> 24]
    return np.int64([len(x), len(rest)]).tobytes() + b"".join(p.astype(np.uint8).tobytes() for p in planes)


def _unplaned(data: bytes) -> np.ndarray:
    n, more = np.frombuffer(data, np.int64, 2).tolist()
    out = np.frombuffer(data, np.uint8, n, 16).astype(np.int64)
    planes = np.frombuffer(data, np.uint8, 4 * more, 16 + n).reshape(4, more).astype(np.int64)
    out[out == 255] += planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24
    return out


def _numbering(words: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Words in the order in which they are numbered: small numbers for frequent ones, and neighbours that begin alike."""
    place = np.empty(len(words), np.int64)
    place[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
    return np.lexsort((place, -np.floor(np.log2(counts))))


def _stored_slices(docs: DataFrame, shared, id_col: str, text_col: str, slice_bytes: int) -> DataFrame:
    """(slice, doc_ids, n_words, numbers, sizes, words, n_bytes): texts as numbers of their slice's distinct chunks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        model, task, number = _model(shared.value), TaskContext.get().partitionId(), 0
        for batch in _gathered(batches, slice_bytes):
            whole, starts, n_words = model.cut(raw(batch.column("text")))
            coded = _words(np.diff(np.r_[starts, len(whole)]), whole).dictionary_encode()
            numbers = coded.indices.to_numpy(zero_copy_only=False)
            order = _numbering(coded.dictionary, np.bincount(numbers, minlength=len(coded.dictionary)))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            sizes, words = _layout(coded.dictionary.take(pa.array(order)))
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([
                pa.array([task << 32 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *(pa.array([x], pa.binary()) for x in (pack(n_words), pack(_planes(rank[numbers])), pack(sizes.astype(np.int32)), pack(words))),
                pa.array([len(words)], pa.int64()),
            ], names=["slice", "doc_ids", "n_words", "numbers", "sizes", "words", "n_bytes"])
            number += 1

    cut_ = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"slice long, doc_ids array<{kind}>, n_words binary, numbers binary, sizes binary, words binary, n_bytes long")
    return materialise(cut_, "piece-slices")


def _gathered(batches, limit: int):
    """Rows in slices of at least ``limit`` bytes of text (the last is what remains), and at most about twice that."""
    held, size = [], 0
    for batch in slices(batches, "text", limit):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _asked(stored: DataFrame, parts: int) -> DataFrame:
    """(part, slice, at, sizes, words): the distinct chunks that each slice asks each part for, and their numbers."""
    def deal(batches):
        for batch in batches:
            for number, sizes, words in zip(*(batch.column(c).to_pylist() for c in ("slice", "sizes", "words"))):
                sizes, words = unpack(sizes, "<i4").astype(np.int64), unpack(words)
                if not len(sizes):
                    continue
                part = (_hashes(sizes, words) % np.uint64(parts)).astype(np.int64)
                order, asked = np.argsort(part, kind="stable"), _words(sizes, words)
                for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    own, data = _layout(asked.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(part[at[0]])], pa.int64()), pa.array([number], pa.int64()),
                        *(pa.array([x], pa.binary()) for x in (pack(_planes(np.diff(at, prepend=0))), pack(own.astype(np.int32)), pack(data))),
                    ], names=["part", "slice", "at", "sizes", "words"])

    return stored.select("slice", "sizes", "words").mapInArrow(deal, "part long, slice long, at binary, sizes binary, words binary")


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places start, start + 1, … of runs of ``sizes``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _answered(asked: DataFrame, shared) -> DataFrame:
    """(slice, at, counts, ids): each distinct chunk of a part is segmented once, whatever the number of slices that ask for it."""
    def answer(part: pa.Table) -> pa.Table:
        model, rows = _model(shared.value), part.select(["slice", "at", "sizes", "words"]).to_pylist()
        sizes = [unpack(r["sizes"], "<i4").astype(np.int64) for r in rows]
        coded = _words(np.concatenate(sizes), b"".join(unpack(r["words"]) for r in rows)).dictionary_encode()
        found = [model.segment(coded.dictionary.slice(k, BATCH_WORDS).to_pylist()) for k in range(0, len(coded.dictionary), BATCH_WORDS)]
        ids, counts = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        starts, entry = np.cumsum(counts) - counts, coded.indices.to_numpy(zero_copy_only=False)
        out = []
        for own, r in zip(np.split(entry, np.cumsum([len(x) for x in sizes])[:-1]), rows):
            out.append((r["slice"], r["at"], pack(_planes(counts[own])), pack(ids[_runs(starts[own], counts[own])].astype(model.kind))))
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["slice", "at", "counts", "ids"])

    return asked.groupBy("part").applyInArrow(answer, "slice long, at binary, counts binary, ids binary")


def _encoded(docs: DataFrame, model_file: str, columns: str, make, id_col: str = "doc_id", text_col: str = "text",
             slice_bytes: int = SLICE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``make(model, ids, sizes)`` of the ids of each document; ``columns`` is the schema of what it returns."""
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a model file: its size is fixed
    Model(shared.value)
    kind = docs.schema[id_col].dataType.simpleString()
    stored = _stored_slices(docs, shared, id_col, text_col, slice_bytes)
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    answers = _answered(_asked(stored, 1 + total // part_bytes), shared)

    def place(own: pa.Table, answers: pa.Table) -> pa.Table:
        model, out = _model(shared.value), []
        ats, counts, ids = [], [np.zeros(0, np.int64)], [np.zeros(0, model.kind)]
        for row in answers.to_pylist():
            ats.append(np.cumsum(_unplaned(unpack(row["at"]))))
            counts.append(_unplaned(unpack(row["counts"])))
            ids.append(unpack(row["ids"], model.kind))
        n, ids = np.concatenate(counts), np.concatenate(ids).astype(np.uint32)
        counts, starts = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        if ats:
            counts[np.concatenate(ats)], starts[np.concatenate(ats)] = n, np.cumsum(n) - n
        for row in own.to_pylist():
            n_words, numbers = unpack(row["n_words"], np.int64), _unplaned(unpack(row["numbers"]))
            ends = np.cumsum(n_words)
            # Some documents at a time bound what is held besides the slice.
            turn = (ends - n_words) // ROUND_WORDS
            for docs_ in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(turn)) + 1):
                if len(docs_):
                    low = int(ends[docs_[0]] - n_words[docs_[0]])
                    words = numbers[low:int(ends[docs_[-1]])]
                    before = np.r_[0, np.cumsum(counts[words])]
                    sizes = np.diff(before[np.r_[0, ends[docs_] - low]])
                    out.append(make(model, ids[_runs(starts[words], counts[words])], sizes))
        flat = own.column("doc_ids").combine_chunks().flatten() if own.num_rows else pa.array([], own.schema.field("doc_ids").type.value_type)
        fields = [("doc_id", flat.type), *make.fields]
        return pa.table([flat, *(pa.concat_arrays(c) if c else pa.array([], k) for c, (_, k) in zip(zip(*out) if out else [()] * len(make.fields), make.fields))],
                        schema=pa.schema(fields))

    numbers = stored.select("slice", "doc_ids", "n_words", "numbers")
    return numbers.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(place, f"doc_id {kind}, {columns}")


def _as_ids(model: Model, ids: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])], pa.binary())]


def _as_digests(model: Model, ids: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    numbers = [hashlib.sha256(x[:-1]).hexdigest() for x in _joined(model.numbers, ids, np.cumsum(sizes))]
    texts = [hashlib.sha256(x).hexdigest() for x in model.decode(ids, sizes)]
    return [pa.array(sizes, pa.int64()), pa.array(numbers, pa.string()), pa.array(texts, pa.string())]


_as_ids.fields = [("ids", pa.binary())]
_as_digests.fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def encode_documents(docs: DataFrame, model_file: str, **options) -> DataFrame:
    """(doc_id, ids) of every row: ids as little-endian unsigned 32-bit integers."""
    return _encoded(docs, model_file, "ids binary", _as_ids, **options)


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) as ``encode_documents`` returns them; null ids decode to the empty text."""
    with open(model_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())  # a model file: its size is fixed

    def decode(batches):
        model = _model(shared.value)
        for batch in slices(batches, "ids", SLICE_BYTES // 8):
            own = raw(batch.column("ids"))
            texts = model.decode(np.frombuffer(b"".join(own), "<u4"), np.array([len(x) // 4 for x in own], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def piece_digests(docs: DataFrame, model_file: str, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: the ids in decimal joined by commas, and the text decoded from them."""
    return _encoded(docs, model_file, "n_tokens long, ids_sha256 string, decoded_sha256 string", _as_digests, **options)
