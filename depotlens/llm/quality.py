"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE`` bytes, cut at white space. A passage is encoded from square roots of
its byte and hashed byte-trigram counts, scaled to length 1, through one tanh layer. Gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages of a document, and a logistic layer scores their weighted sum.
All layers are learned together from document labels, by Adam, in NumPy.

The model is fitted on at most ``FIT_ROWS`` labelled documents, those of the least hash of their id; scoring covers every
passage of every text, in tasks that only hold the model (fixed size) and a slice of rows.

Defined cases: a null or empty text is one passage without counts, and is scored like any other; a null id is not held out
by a rule that yields null for it (see ``held_out``); labels that are null or not 0 or 1, and labels without a document, are
left out; repeated labels count as often as they occur; without labelled rows every score is 0.5; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import raw, slices, unused

PASSAGE = 768
COUNTED = 128  # passages counted at once
BUCKETS = 2048
HIDDEN, GATE = 32, 16
FIT_BYTES = 256 << 20
FIT_ROWS = 4000
EPOCHS, STEPS, BATCH, RATE, DECAY = 24, 400, 64, 3e-3, 1e-4  # as many epochs as make STEPS steps, EPOCHS at least
THRESHOLD = 0.3
SLICE_BYTES = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"


def passages(text: bytes) -> list[bytes]:
    """``text`` in pieces of ``PASSAGE`` bytes, each up to the next white space within as many bytes again."""
    out, at = [], 0
    while len(text) - at > PASSAGE:
        space = text.find(b" ", at + PASSAGE, at + 2 * PASSAGE)
        stop = space + 1 if space >= 0 else at + 2 * PASSAGE
        out.append(text[at:stop])
        at = stop
    if at < len(text) or not out:
        out.append(text[at:])
    return out


def features(pieces: list[bytes]) -> np.ndarray:
    """A row per passage: square roots of byte and trigram counts, scaled to length 1."""
    width = 256 + BUCKETS
    rows = np.empty((len(pieces), width), np.float32)
    for low in range(0, len(pieces), COUNTED):  # counts are 64-bit integers: only so many are held at once
        rows[low:low + COUNTED] = _counted(pieces[low:low + COUNTED], width)
    return rows


def _counted(pieces: list[bytes], width: int) -> np.ndarray:
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    counts = np.bincount(owner * width + data, minlength=len(pieces) * width).astype(np.float32)
    if len(data) > 2:
        inside = owner[:-2] == owner[2:]
        hashed = ((data[:-2] * np.uint32(0x9E3779B1) + data[1:-1]) * np.uint32(0x85EBCA6B) + data[2:]) * np.uint32(0xC2B2AE35)
        bucket = (hashed >> np.uint32(16)) % np.uint32(BUCKETS)
        counts += np.bincount((owner[:-2] * width + 256 + bucket)[inside], minlength=len(counts))
    rows = np.sqrt(counts).reshape(len(pieces), width)
    return rows / np.maximum(np.sqrt((rows ** 2).sum(1, keepdims=True)), 1e-9)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedAttention:
    """The model; ``weights`` holds all its arrays."""

    def __init__(self, prior: float = 0.5, seed: int = 7):
        r, d = np.random.default_rng(seed), 256 + BUCKETS
        scaled = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {
            "W": scaled(d, HIDDEN) * 8, "b": np.zeros(HIDDEN, np.float32), "V": scaled(HIDDEN, GATE), "v": np.zeros(GATE, np.float32),
            "U": scaled(HIDDEN, GATE), "u": np.zeros(GATE, np.float32), "w": scaled(GATE, 1)[:, 0], "c": scaled(HIDDEN, 1)[:, 0],
            "d": np.array([np.log(prior / (1 - prior))], np.float32)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """``first``: the first passage of each document."""
        m = self.weights
        h = np.tanh(x @ m["W"] + m["b"])
        t, g = np.tanh(h @ m["V"] + m["v"]), _sigmoid(h @ m["U"] + m["u"])
        s = (t * g) @ m["w"]
        sizes = np.diff(np.r_[first, len(x)])
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "sizes": sizes, "first": first, "p": _sigmoid(z @ m["c"] + m["d"])}

    def gradient(self, f: dict, y: np.ndarray) -> dict:
        m, first, sizes = self.weights, f["first"], f["sizes"]
        dl = (f["p"] - y) / len(y)
        dz = np.repeat(dl, sizes)[:, None] * m["c"]
        da = (dz * f["h"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), sizes))
        dt = ds[:, None] * m["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * m["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "v": dt.sum(0), "U": f["h"].T @ dg, "u": dg.sum(0),
                "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dl, "d": dl.sum(keepdims=True)}

    def score(self, texts: list[bytes]) -> np.ndarray:
        pieces = [passages(t) for t in texts]
        sizes = np.array([len(p) for p in pieces])
        return self.forward(features([p for own in pieces for p in own]), np.cumsum(sizes) - sizes)["p"]


def fit(texts: list[bytes], labels: list[int]) -> GatedAttention | None:
    """Learn from whole texts; None without any."""
    if not texts:
        return None
    y = np.array(labels, np.float32)
    model = GatedAttention(float(np.clip(y.mean(), 0.05, 0.95)))
    pieces = [passages(t) for t in texts]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    order, step = np.random.default_rng(11), 0
    epochs = max(EPOCHS, STEPS * BATCH // len(texts))
    for epoch in range(epochs):
        shuffled = order.permutation(len(texts))
        for at in range(0, len(texts), BATCH):
            chosen = shuffled[at:at + BATCH]
            sizes = np.array([len(pieces[i]) for i in chosen])
            x = features([p for i in chosen for p in pieces[i]])
            grad = model.gradient(model.forward(x, np.cumsum(sizes) - sizes), y[chosen])
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.weights[k] -= (rate * (m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) + rate * DECAY * model.weights[k])).astype(np.float32)
    return model


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id reads as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                held_out: int = 0, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> GatedAttention | None:
    """The model of labelled documents outside the held-out fold: in the order of a hash, until there are ``rows`` or they have ``most_bytes``."""
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != held_out))
    chosen = chosen.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)  # so that its broadcast has a fixed bound
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t")).join(F.broadcast(chosen), "_id")
    order = [F.xxhash64("_id").alias("_h"), "_id", "_y", F.md5("_t").alias("_m")]
    sizes = found.select(*order, F.coalesce(F.octet_length("_t"), F.lit(0)).alias("_n")).orderBy("_h", "_id", "_y", "_m").limit(rows).collect()
    taken, held = 0, 0
    for r in sizes:
        held += r._n
        if taken and held > most_bytes:
            break
        taken += 1
    found = found.orderBy(F.xxhash64("_id"), "_id", "_y", F.md5("_t")).limit(taken).select("_t", "_y").collect() if taken else []
    return fit([bytes(r._t or b"") for r in found], [r._y for r in found])


def with_quality(docs: DataFrame, model: GatedAttention | None, text_col: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the column ``score``: how likely label 1 is, in [0, 1]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def score_all(batches):
        for batch in slices(batches, text_col, SLICE_BYTES):
            p = shared.value.score(raw(batch.column(text_col))) if shared.value else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.float64))], names=[*names, score])

    return docs.mapInArrow(score_all, docs.select(*names, F.lit(0.0).alias(score)).schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit_quality(docs, labels, id_col, text_col)
    scored = with_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    score, = unused(docs.columns, "_quality")
    model = fit_quality(docs, labels, id_col, text_col)
    return with_quality(docs, model, text_col, score).where(F.col(score) >= threshold).drop(score)
