"""Canonical length-limited Huffman codes over integer ids, with lane-wise encoding and decoding in NumPy."""

from __future__ import annotations

import numpy as np

LEAST_BITS = 18
LANE = 256  # ids between two bit-offset checkpoints


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive ``counts``, by package-merge."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit in codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    merged, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(is_leaf):
        n_leaves = int(level[:take].sum())
        lengths[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    result = np.empty(n, np.int64)
    result[order] = lengths
    return result


class Code:
    """Codes of the ids in ``ids`` (ascending) with their ``counts``; shorter codes first, then smaller ids."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.bits = max(LEAST_BITS, int(len(ids)).bit_length() + 1)
        lengths = code_lengths(counts, self.bits) if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((ids, lengths))
        spans = np.left_shift(1, self.bits - lengths[order]) if len(ids) else np.zeros(0, np.int64)
        starts = np.cumsum(spans) - spans
        self.ids, self.lengths = ids[order], lengths[order]
        size = int(ids[-1]) + 1 if len(ids) else 0
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids] = starts >> (self.bits - self.lengths)
        self.length_of[self.ids] = self.lengths

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every ``bits``-bit prefix: the id it starts with and the length of its code."""
        spans = np.left_shift(1, self.bits - self.lengths)
        fill = (1 << self.bits) - int(spans.sum())
        return np.r_[np.repeat(self.ids, spans), np.zeros(fill, self.ids.dtype)], np.r_[np.repeat(self.lengths, spans), np.ones(fill, np.int64)]

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bit stream of ``ids`` and, for every ``LANE`` ids, the bit at which they start."""
        lengths = self.length_of[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        n_bits = int(ends[-1]) if len(ids) else 0
        words = np.zeros(n_bits // 32 + 2, np.uint64)
        at = starts >> 5
        value = self.code_of[ids] << (64 - lengths - (starts & 31)).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, np.diff(at) != 0]) if len(ids) else np.zeros(0, np.int64)
        if len(ids):  # the bits of different ids are disjoint, so sums are unions
            words[at[first]] += np.add.reduceat(value >> np.uint64(32), first)
            words[at[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes()[: (n_bits + 7) // 8], starts[::LANE].astype("<u4").tobytes()


def decode(blocks: list[tuple[bytes, bytes, int]], table: tuple[np.ndarray, np.ndarray], bits: int) -> list[np.ndarray]:
    """The ids of (stream, checkpoints, number of ids) blocks; all lanes of all blocks advance together."""
    ids, lengths = table
    lanes = [np.frombuffer(c, "<u4").astype(np.int64) for _, c, _ in blocks]
    bases = np.cumsum([0] + [len(s) for s, _, _ in blocks])
    position = np.concatenate([x + 8 * b for x, b in zip(lanes, bases)]) if lanes else np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(s for s, _, _ in blocks) + bytes(8), np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    last, mask = 8 * (len(window) - 1), np.uint32((1 << bits) - 1)
    out = np.empty((len(position), LANE), ids.dtype)
    for step in range(LANE):
        prefix = (window[position >> 3] >> (32 - bits - (position & 7)).astype(np.uint32)) & mask
        out[:, step] = ids[prefix]
        position = np.minimum(position + lengths[prefix], last)
    result, at = [], 0
    for x, (_, _, n) in zip(lanes, blocks):
        result.append(out[at:at + len(x)].reshape(-1)[:n])
        at += len(x)
    return result
