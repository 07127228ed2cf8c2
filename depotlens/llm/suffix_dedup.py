"""Exact substring dedup by a distributed, common-prefix-aware merge sort of sampled suffixes.

Every byte that is covered by a string of ``LENGTH`` bytes which also starts anywhere else is removed.

Sampled suffixes. The anchor of a string is the position of the least hash among its first ``WINDOW`` positions (16 bytes
each, the first one at ties). Equal strings have their anchors at the same place, so it is enough to compare the suffixes
that start at anchors, about one in ``WINDOW / 2`` bytes, with the bytes on their left. An anchor of a repeated string shares
at least ``SHARED`` bytes to the right with another one.

1. Duplicate detection. Each chunk of texts sends the hashes of the ``SHARED`` bytes at its anchors, once each, to hash
   parts, which tell it which of them occur elsewhere. Other suffixes cannot be part of a repeated string and stay at home.
2. Runs. Each chunk sorts the remaining suffixes (up to ``LENGTH`` bytes), joins equal ones, front-codes them and sends them to
   range parts. Splitters come from a hash sample of repeated suffixes; suffixes that share ``SHARED`` bytes are not parted.
3. Merge. A part merges its runs with a loser tree that compares only bytes behind known prefixes, which also yields the
   common prefix of neighbours. For every offset of a string before its anchor, suffixes are grouped by what they share to
   the right (from the prefixes) and to the left; a string is repeated if its group has two members.
4. Hot prefixes. Suffixes whose first ``SHARED`` bytes occur more than ``HOT`` times, as those of a short passage that many
texts go on from in their own way, would all meet in one part, so they are not merged. Each chunk sends the hashes of the
strings of ``LENGTH`` bytes that have such an anchor to hash parts, once each, and is told which occur elsewhere. The first
and the last of those at every anchor give its range: all strings with their hashes are counted by their bytes, in an
aggregate that combines, and joined back on a key that Spark can split. One that is alone after all (its hash is another
string's, too) is left out, and first and last ones are chosen again.
5. Each chunk gets the removed ranges around its anchors and cuts its texts.

All of this is exact: hashes only choose anchors and drop what is alone. A chunk sends one packed row per part to the merge, which
gets at most ``HOT`` entries of a prefix; a string at a hot prefix costs one entry per chunk, not one per row.

Defined cases: a null text is empty; texts below ``LENGTH`` bytes lose nothing; a repeated row counts as another occurrence;
ids may be null or repeat; matches never cross rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.sources.scratch import materialise

from .arrow import mix
from .chunks import CHUNK_BYTES, grouped, pack, split_texts, store_chunks, unpack
from .loser_tree import merge

LENGTH = 400
GRAM = 16
BLOCK_BYTES = 1 << 20
SAMPLES = 256  # sampled suffixes per part
HOT = 1024  # occurrences of a prefix that a part merges

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_ROWS = "part long, chunk long, kind string, data binary"


def _window(length: int) -> int:
    return length // 2


def _gram(length: int) -> int:
    return max(1, min(GRAM, length - _window(length) + 1))


def _shared(length: int) -> int:
    return length - _window(length) + 1


def anchors(data: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Positions of the anchors of all strings of ``length`` bytes inside each text, ascending."""
    return anchored(data, sizes, length)[0]


def anchored(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors, and for each the first start and the number of the strings that have it; their starts follow one another."""
    n, window, gram = len(data), _window(length), _gram(length)
    ends = np.cumsum(sizes)
    inside = np.maximum(sizes - length + 1, 0)  # strings that start in each text
    if not inside.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Hash of the bytes at each position, by doubling.
    value, have, out, done = _SYMBOL[data], 1, None, 0
    while True:
        if gram & have:
            tail = np.zeros(n, np.uint64)
            tail[: n - done] = value[done:]
            out = value.copy() if out is None else out * _FACTOR + tail
            done += have
        if done == gram:
            break
        nxt = np.zeros(n, np.uint64)
        nxt[: n - have] = value[have:]
        value = mix(value) + nxt * _FACTOR
        have *= 2
    low = (mix(out) >> np.uint64(32)) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    have = 1
    while 2 * have <= window:
        low[: n - have] = np.minimum(low[: n - have], low[have:])
        have *= 2
    if have < window:
        low[: n - (window - have)] = np.minimum(low[: n - (window - have)], low[window - have:])
    starts = np.repeat(ends - sizes, inside) + np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside)
    at = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], starts[first], np.diff(np.r_[first, len(at)])


def _hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes at each position; positions ascend."""
    if not len(at):
        return np.zeros(0, np.uint64)
    power = np.full(len(data) + 1, _FACTOR, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * power[:-1], out=total[1:])
    back = np.full(int(at[-1]) + 1, _INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mix((total[at + size] - total[at]) * back[at])


def _text_blocks(sizes: np.ndarray):
    """(first text, last text, start, end) of about ``BLOCK_BYTES`` of texts at a time, to save memory."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        start = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, start + BLOCK_BYTES, "right")))
        yield first, last, start, int(ends[last - 1])
        first = last


def anchor_hashes(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a chunk and a hash of the bytes at each."""
    at, _, _, hashes = _anchored_hashes(data, sizes, length)
    return at, hashes


def _anchored_hashes(data: np.ndarray, sizes: np.ndarray, length: int) -> list[np.ndarray]:
    """The anchors of a chunk, the first start and number of strings of each, and a hash of the bytes at each."""
    found = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
    for first, last, start, end in _text_blocks(sizes):
        block = data[start:end]
        at, begin, count = anchored(block, sizes[first:last], length)
        found.append([at + start, begin + start, count, _hashes(block, at, _shared(length))])
    return [np.concatenate(x) for x in zip(*found)]


def _buffer(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    whole = unpack(row["texts"])
    return np.frombuffer(whole, np.uint8), np.array(row["sizes"], np.int64), whole


def _rows(out: list[tuple]) -> list[pa.Array]:
    part, chunk, kind, data = zip(*out) if out else ([], [], [], [])
    return [pa.array(part, pa.int64()), pa.array(chunk, pa.int64()), pa.array(kind, pa.string()), pa.array(data, pa.binary())]


_NAMES = ["part", "chunk", "kind", "data"]


def _owners(own: np.ndarray, parts: int) -> np.ndarray:
    return (own % np.uint64(parts)).astype(np.int64)


def _counted(chunk: int, own: np.ndarray, n: np.ndarray, parts: int) -> list[tuple]:
    """Rows that send different hashes, ascending, and their counts to their parts."""
    owner = _owners(own, parts)
    order = np.argsort(owner, kind="stable")
    return [(p, chunk, "h", pack(np.concatenate([own[k], n[k].astype(np.uint64)]))) for p, k in grouped(owner[order], order)]


def _answered(own: np.ndarray, flags: dict[int, bytes], parts: int) -> np.ndarray:
    """What the parts answered to each of the hashes that ``_counted`` sent."""
    owner = _owners(own, parts)
    order = np.argsort(owner, kind="stable")
    found = np.zeros(len(own), np.uint8)
    for p, k in grouped(owner[order], order):
        found[k] = unpack(flags[p], "u1")
    return found


def _prefixes(chunks: DataFrame, parts: int, length: int, every: int) -> DataFrame:
    """Each chunk's different hashes with their counts, per part, and sampled strings."""
    shared = _shared(length)

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, sizes, whole = _buffer(row)
                at, hashes = anchor_hashes(data, sizes, length)
                own, first, n = np.unique(hashes, return_index=True, return_counts=True)
                owner = _owners(own, parts)
                out = _counted(row["chunk"], own, n, parts)
                for k in np.flatnonzero(own // np.uint64(parts) % np.uint64(every) == 0).tolist():
                    place = int(at[first[k]])
                    out.append((int(owner[k]), row["chunk"], "s", int(own[k]).to_bytes(8, "little") + whole[place:place + shared]))
                yield pa.RecordBatch.from_arrays(_rows(out), names=_NAMES)

    return chunks.select("chunk", "sizes", "texts").mapInArrow(send, _ROWS)


def _repeated(sent: DataFrame, parts: int, hot: int | None = None) -> DataFrame:
    """Which of its hashes (ascending, per part) occur elsewhere (1) or more than ``hot`` times (2), for each chunk; sampled
    strings of the former, with weights; a row of kind "t" from each part with one of the latter."""
    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [np.split(unpack(r["data"], "u8"), 2) for r in rows if r["kind"] == "h"]
        every, where = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        total = np.bincount(where, np.concatenate([x[1] for x in lists]).astype(np.int64), len(every))
        entries = np.bincount(where, minlength=len(every))
        state = (total > 1).astype(np.uint8)
        if hot is not None:
            state[total > max(1, hot)] = 2
        out, at = [], 0
        for r, (own, _) in zip((r for r in rows if r["kind"] == "h"), lists):
            out.append((r["part"], r["chunk"], "d", pack(state[where[at:at + len(own)]])))
            at += len(own)
        if (state == 2).any():
            out.append((rows[0]["part"], -1, "t", b""))
        samples = {r["data"] for r in rows if r["kind"] == "s"}
        for s in sorted(samples):
            k = int(np.searchsorted(every, np.uint64(int.from_bytes(s[:8], "little"))))
            if state[k] == 1:
                out.append((int(entries[k]), -1, "s", s[8:]))
        return pa.Table.from_arrays(_rows(out), names=_NAMES)

    return sent.repartition(parts, "part").groupBy("part").applyInArrow(answer, _ROWS)


def _splitters(answers: DataFrame, parts: int) -> list[bytes]:
    """At most ``parts - 1`` strings; the sample they come from has some hundred strings per part."""
    rows = sorted((bytes(r.data), r.part) for r in answers.where("kind = 's'").select("data", "part").toLocalIterator())
    total, seen, out = sum(n for _, n in rows), 0, []
    for text, n in rows:
        seen += n
        if rows and seen * parts >= total * (len(out) + 1) and len(out) < parts - 1 and (not out or text > out[-1]):
            out.append(text)
    return out


def _front_coded(entries: list[tuple[bytes, bytes, list[int]]]) -> bytes:
    """A sorted run: per entry the bytes shared with the one before, what follows them, its left side and its places."""
    last, shared, tails = b"", [], []
    for right, _, _ in entries:
        k, n = 0, min(len(last), len(right))
        while k + 16 <= n and last[k:k + 16] == right[k:k + 16]:
            k += 16
        while k < n and last[k] == right[k]:
            k += 1
        shared.append(k)
        tails.append(right[k:])
        last = right
    numbers = np.array([*shared, *map(len, tails), *(len(x[1]) for x in entries), *(len(x[2]) for x in entries)], np.int64)
    places = np.array([p for x in entries for p in x[2]], np.int64)
    head = np.array([len(entries), len(places)], np.int64)
    return pack(b"".join([head.tobytes(), numbers.tobytes(), places.tobytes(), *tails, *(x[1] for x in entries)]))


class _Run:
    """Reads a front-coded run."""

    def __init__(self, chunk: int, data: bytes):
        self.chunk = chunk
        plain = unpack(data)
        n, n_places = np.frombuffer(plain, np.int64, 2).tolist()
        self.shared, self.tails, self.lefts, self.counts = np.frombuffer(plain, np.int64, 4 * n, 16).reshape(4, n).tolist()
        at = 16 + 32 * n
        self.places = np.frombuffer(plain, np.int64, n_places, at)
        self.plain, self.at = plain, at + 8 * n_places

    def __iter__(self):
        text, at, left_at, place = b"", self.at, self.at + sum(self.tails), 0
        for shared, tail, left, count in zip(self.shared, self.tails, self.lefts, self.counts):
            text = text[:shared] + self.plain[at:at + tail]
            yield shared, text, (self.chunk, self.plain[left_at:left_at + left], self.places[place:place + count])
            at, left_at, place = at + tail, left_at + left, place + count


def _runs(chunks: DataFrame, answers: DataFrame, parts: int, length: int, splitters: list[bytes]) -> DataFrame:
    """Each chunk's sorted, front-coded run of suffixes that may repeat, but for hot ones, cut at the splitters."""
    window, shared = _window(length), _shared(length)
    cuts = chunks.sparkSession.sparkContext.broadcast(splitters)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        flags = {r["part"]: r["data"] for r in right.to_pylist()}
        for row in left.to_pylist():
            data, sizes, whole = _buffer(row)
            at, hashes = anchor_hashes(data, sizes, length)
            own, which = np.unique(hashes, return_inverse=True)
            at = at[_answered(own, flags, parts)[which] == 1]
            ends = np.cumsum(sizes)
            text = np.searchsorted(ends, at, "right")
            found: dict[tuple[bytes, bytes], list[int]] = {}
            for place, first, end in zip(at.tolist(), (ends - sizes)[text].tolist(), ends[text].tolist()):
                before = whole[max(first, place - window + 1):place][::-1]
                found.setdefault((whole[place:min(end, place + length)], before), []).append(place)
            entries = sorted((r, before, places) for (r, before), places in found.items())
            part = [bisect_right(cuts.value, r[:shared]) for r, _, _ in entries]
            start = 0
            for k in range(1, len(entries) + 1):
                if k == len(entries) or part[k] != part[start]:
                    out.append((part[start], row["chunk"], "r", _front_coded(entries[start:k])))
                    start = k
        return pa.Table.from_arrays(_rows(out), names=_NAMES)

    own = answers.where("kind = 'd'")
    return chunks.select("chunk", "sizes", "texts").groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(send, _ROWS)


def repeated_offsets(rights: list[bytes], shared: np.ndarray, lefts: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset, before its anchor, of the repeated strings around each suffix (greatest -1: none).

    ``rights`` ascend and ``shared[k]`` is what k shares with k - 1; ``lefts`` are read away from the anchor; ``copies`` is
    how often each entry occurs.
    """
    n, window, least = len(rights), _window(length), _shared(length)
    low, high = np.full(n, length), np.full(n, -1)
    cluster = np.cumsum(np.r_[True, shared[1:] < least]) - 1 if n else np.zeros(0, np.int64)
    alone = np.bincount(cluster, copies)[cluster] < 2 if n else np.zeros(0, bool)
    keep = np.flatnonzero(~alone)
    if not len(keep):
        return low, high
    right_size, left_size = np.array([len(rights[k]) for k in keep]), np.array([len(lefts[k]) for k in keep])
    # Entries of a cluster are kept or dropped together, so neighbours stay neighbours.
    right_shared = np.where(np.r_[True, cluster[keep][1:] != cluster[keep][:-1]], 0, shared[keep])
    by_left = sorted(range(len(keep)), key=lambda k: (cluster[keep[k]], lefts[keep[k]]))
    left_shared = np.zeros(len(keep), np.int64)
    for k in range(1, len(keep)):
        a, b = by_left[k - 1], by_left[k]
        if cluster[keep[a]] == cluster[keep[b]]:
            x, y = lefts[keep[a]], lefts[keep[b]]
            m, top = 0, min(len(x), len(y))
            while m + 16 <= top and x[m:m + 16] == y[m:m + 16]:
                m += 16
            while m < top and x[m] == y[m]:
                m += 1
            left_shared[k] = m
        else:
            left_shared[k] = -1
    by_left, group_left = np.array(by_left), np.empty(len(keep), np.int64)
    least_, most, weight = low[keep], high[keep], copies[keep]
    for offset in range(window):
        fits = (right_size >= length - offset) & (left_size >= offset)
        if not fits.any():
            continue
        group_left[by_left] = np.cumsum(left_shared < offset)
        group = np.cumsum(right_shared < length - offset) * (len(keep) + 1) + group_left
        group = group[fits]
        _, where = np.unique(group, return_inverse=True)
        again = np.flatnonzero(fits)[np.bincount(where, weight[fits])[where] > 1]
        least_[again] = np.minimum(least_[again], offset)
        most[again] = offset
    low[keep], high[keep] = least_, most
    return low, high


def _ranges(runs: DataFrame, parts: int, length: int) -> DataFrame:
    """Per chunk: anchor places and the removed range around each."""
    def sort(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rights, shared, lefts, copies, origin = [], [], [], [], []
        for k, text, (chunk, left, places) in merge([_Run(r["chunk"], r["data"]) for r in rows]):
            rights.append(text)
            shared.append(k)
            lefts.append(left)
            copies.append(len(places))
            origin.append((chunk, places))
        low, high = repeated_offsets(rights, np.array(shared, np.int64), lefts, np.array(copies, np.int64), length)
        found: dict[int, list[np.ndarray]] = {}
        for k in np.flatnonzero(high >= 0).tolist():
            chunk, places = origin[k]
            found.setdefault(chunk, []).append(np.stack([places - high[k], places - low[k] + length]))
        out = [(rows[0]["part"], chunk, "x", pack(np.concatenate(x, axis=1))) for chunk, x in found.items()]
        return pa.Table.from_arrays(_rows(out), names=_NAMES)

    return runs.repartition(parts, "part").groupBy("part").applyInArrow(sort, _ROWS)


def _hot_strings(chunks: DataFrame, answers: DataFrame, parts: int, length: int) -> DataFrame:
    """Each chunk's strings at hot prefixes: the first start and number of those at each anchor, where the first one lies in
    the bytes that follow, and the bytes that they cover."""
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        flags = {r["part"]: r["data"] for r in right.to_pylist()}
        for row in left.to_pylist():
            data, sizes, _ = _buffer(row)
            _, first, count, hashes = _anchored_hashes(data, sizes, length)
            own, which = np.unique(hashes, return_inverse=True)
            hot = _answered(own, flags, parts)[which] == 2
            first, count = first[hot], count[hot]
            if len(first):
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + count - 1 + length, -1)
                covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
                head = np.concatenate([[len(first)], first, count, np.cumsum(covered)[first] - 1]).astype(np.int64)
                out.append((0, row["chunk"], "c", pack(head.tobytes() + data[covered].tobytes())))
        return pa.Table.from_arrays(_rows(out), names=_NAMES)

    own = answers.where("kind = 'd'")
    return chunks.select("chunk", "sizes", "texts").groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(send, _ROWS)


def _read_strings(packed: bytes, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of each string: its start, its anchor's number, its place in the bytes and its hash; and the bytes."""
    plain = unpack(packed)
    n = int(np.frombuffer(plain, np.int64, 1)[0])
    first, count, at = np.frombuffer(plain, np.int64, 3 * n, 8).reshape(3, n)
    data = plain[8 + 24 * n:]
    anchor = np.repeat(np.arange(n), count)
    step = np.arange(len(anchor)) - np.repeat(np.cumsum(count) - count, count)
    place, buffer, hashes, k = at[anchor] + step, np.frombuffer(data, np.uint8), [], 0
    while k < len(place):
        begin = int(place[k])
        last = int(np.searchsorted(place, begin + BLOCK_BYTES, "right"))
        hashes.append(_hashes(buffer[begin:int(place[last - 1]) + length], place[k:last] - begin, length))
        k = last
    return first[anchor] + step, anchor, place, np.concatenate(hashes) >> np.uint64(64 - bits), data


def _wanted(sent: DataFrame, parts: int) -> DataFrame:
    """Which of its hashes (kind "h") any chunk has chosen (kind "w"), for each chunk."""
    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        chosen = [unpack(r["data"], "u8") for r in rows if r["kind"] == "w"]
        chosen, out = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.uint64), []
        for r in rows:
            if r["kind"] == "h":
                own = np.split(unpack(r["data"], "u8"), 2)[0]
                out.append((r["part"], r["chunk"], "d", pack(np.isin(own, chosen).astype(np.uint8))))
        return pa.Table.from_arrays(_rows(out), names=_NAMES)

    return sent.repartition(parts, "part").groupBy("part").applyInArrow(answer, _ROWS)


def _hot_ranges(strings: DataFrame, parts: int, length: int, bits: int = 64) -> DataFrame:
    """Per chunk: ranges of repeated strings at hot prefixes."""
    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, n = np.unique(_read_strings(row["data"], length, bits)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays(_rows(_counted(row["chunk"], own, n, parts)), names=_NAMES)

    def choose(alone):
        def send(left: pa.Table, right: pa.Table) -> pa.Table:
            out, flags = [], {r["part"]: r["data"] for r in right.to_pylist()}
            for row in left.to_pylist():
                start, anchor, _, hashes, _ = _read_strings(row["data"], length, bits)
                own, which = np.unique(hashes, return_inverse=True)
                again = np.flatnonzero((_answered(own, flags, parts)[which] > 0) & ~np.isin(start, alone.value.get(row["chunk"], [])))
                edge = anchor[again][1:] != anchor[again][:-1]
                ends = np.r_[again[np.r_[True, edge]], again[np.r_[edge, True]]] if len(again) else again
                chosen = np.unique(hashes[ends])
                owner = _owners(chosen, parts)
                order = np.argsort(owner, kind="stable")
                out.extend((p, row["chunk"], "w", pack(chosen[k])) for p, k in grouped(owner[order], order))
            return pa.Table.from_arrays(_rows(out), names=_NAMES)
        return send

    def fetch(alone):
        def send(left: pa.Table, right: pa.Table) -> pa.Table:
            chunks, found, flags = [], [], {r["part"]: r["data"] for r in right.to_pylist()}
            for row in left.to_pylist():
                start, _, place, hashes, data = _read_strings(row["data"], length, bits)
                own, which = np.unique(hashes, return_inverse=True)
                keep = (_answered(own, flags, parts)[which] > 0) & ~np.isin(start, alone.value.get(row["chunk"], []))
                starts: dict[bytes, list[int]] = {}
                for s, p in zip(start[keep].tolist(), place[keep].tolist()):
                    starts.setdefault(data[p:p + length], []).append(s)
                found.extend(starts.items())
                chunks.extend([row["chunk"]] * len(starts))
            ranges = [np.array([x, x]) + [[0], [length]] for _, x in found]
            return pa.Table.from_arrays([pa.array(chunks, pa.int64()), pa.array([x for x, _ in found], pa.binary()),
                                         pa.array([len(x) for _, x in found], pa.int64()), pa.array(map(pack, ranges), pa.binary())], names=names)
        return send

    spark, names, alone = strings.sparkSession, ["chunk", "string", "n", "data"], {}
    sent = materialise(strings.mapInArrow(count, _ROWS), "string-hashes")
    answers = materialise(_repeated(sent, parts).where("kind = 'd'"), "string-answers")
    while True:
        known = spark.sparkContext.broadcast({c: np.concatenate(x) for c, x in alone.items()})
        chosen = strings.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(choose(known), _ROWS)
        wanted = _wanted(sent.unionByName(chosen), parts)
        fetched = strings.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(fetch(known), "chunk long, string binary, n long, data binary")
        fetched = materialise(fetched, "repeated-strings")
        total = fetched.groupBy("string").agg(F.sum("n").alias("total"))
        lone = fetched.join(total.where("total < 2"), "string").select("chunk", "data").collect()  # as many as hashes that are two strings'
        if not lone:
            return fetched.select(F.lit(0).cast("long").alias("part"), "chunk", F.lit("x").alias("kind"), "data")
        for r in lone:
            alone.setdefault(r["chunk"], []).append(unpack(r["data"], "i8")[:1])


def substring_dedup(docs: DataFrame, make, schema: T.StructType, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """``make(texts, removed)`` for every chunk: a list of columns after ``doc_id``, as in ``schema``.

    ``texts`` are the bytes of each text and ``removed`` its maximal removed ranges, (starts, ends).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chunks = store_chunks(rows, chunk_bytes=chunk_bytes)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = max(1, total * 2 // _window(length) // (SAMPLES * parts))
    answers = materialise(_repeated(_prefixes(chunks, parts, length, every), parts, hot), "repeated-prefixes")
    runs = _runs(chunks, answers, parts, length, _splitters(answers, parts))
    ranges = materialise(_ranges(runs, parts, length), "repeated-ranges")
    if not answers.where("kind = 't'").isEmpty():
        strings = materialise(_hot_strings(chunks, answers, parts, length), "hot-strings")
        ranges = ranges.unionByName(_hot_ranges(strings, parts, length))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            data, sizes, whole = _buffer(row)
            edge = np.zeros(len(data) + 1, np.int32)
            for r in right.to_pylist():
                starts, ends = unpack(r["data"], "i8").reshape(2, -1)
                np.add.at(edge, starts, 1)
                np.add.at(edge, ends, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            removed, at = [], 0
            for n in sizes.tolist():
                step = np.flatnonzero(np.diff(np.r_[0, gone[at:at + n].astype(np.int8), 0]))
                removed.append((step[::2], step[1::2]))
                at += n
            names = [r["doc_id"] for r in row["rows"]]
            kind = left.schema.field("rows").type.value_type.field("doc_id").type
            tables.append(pa.Table.from_arrays([pa.array(names, kind), *make(split_texts(row["sizes"], whole), removed)], names=schema.names))
        return pa.concat_tables(tables)

    return chunks.select("chunk", "rows", "sizes", "texts").groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(cut, schema)


def _kept(text: bytes, removed: tuple[np.ndarray, np.ndarray]) -> bytes:
    edges = [0, *(x for pair in zip(*(r.tolist() for r in removed)) for x in pair), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, kept, removed): the remaining bytes of every row and the byte ranges that were cut."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("kept", T.BinaryType()),
                           T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))])

    def make(texts, removed):
        return [pa.array([_kept(t, r) for t, r in zip(texts, removed)], pa.binary()),
                pa.array([[list(x) for x in zip(a.tolist(), b.tolist())] for a, b in removed], pa.list_(pa.list_(pa.int64())))]

    return substring_dedup(docs, make, schema, id_col, text_col, **options)


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    longs = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *longs, T.StructField("kept_sha256", T.StringType())])

    def make(texts, removed):
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array([int((b - a).sum()) for a, b in removed], pa.int64()),
                pa.array([len(a) for a, _ in removed], pa.int64()), pa.array([hashlib.sha256(_kept(t, r)).hexdigest() for t, r in zip(texts, removed)])]

    return substring_dedup(docs, make, schema, id_col, text_col, **options)
