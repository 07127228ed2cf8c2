"""Whole texts packed into rows of some megabytes, with a key that other tables can answer to.

A chunk is written once, so its key and its bytes stay the same whatever is computed again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from depotlens.sources.scratch import materialise

from .arrow import raw, slices

CHUNK_BYTES = 8 << 20


def pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def unpack(x: bytes, kind: str | None = None):
    """Bytes, or an array of ``kind``."""
    plain = zstandard.ZstdDecompressor().decompress(x)
    return plain if kind is None else np.frombuffer(plain, kind)


def store_chunks(docs: DataFrame, change=None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, rows, sizes, n_bytes, texts) from rows with a ``text``; ``rows`` holds their other columns.

    ``change`` maps the bytes of a text to those that are stored; a null text is empty.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType(others))),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("n_bytes", T.LongType()), T.StructField("texts", T.BinaryType())])

    def store(batches):
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text", chunk_bytes)):
            texts = raw(batch.column("text"))
            if change:
                texts = [change(t) for t in texts]
            sizes = [len(t) for t in texts]
            kept = [batch.schema.get_field_index(f.name) for f in others]
            rows = pa.StructArray.from_arrays([batch.column(k) for k in kept], fields=[batch.schema.field(k) for k in kept])
            yield pa.RecordBatch.from_arrays([
                pa.array([task << 32 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([sum(sizes)], pa.int64()), pa.array([pack(b"".join(texts))], pa.binary()),
            ], names=["chunk", "rows", "sizes", "n_bytes", "texts"])

    return materialise(docs.mapInArrow(store, schema), "chunks")


def split_texts(sizes: list[int], whole: bytes) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [whole[b - n:b] for n, b in zip(sizes, ends)]


def grouped(owner: np.ndarray, order: np.ndarray):
    """(owner, indices) for each run of equal owners, where ``order`` are indices in the order of ``owner``."""
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        yield from zip(owner[first].tolist(), np.split(order, first[1:]))
