"""An FM-index over word ids: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``rank`` by prefix doubling; its last entry must be its only least one."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0])
    at = np.repeat(first, np.diff(np.r_[first, n]))
    place = np.empty(n, np.int64)
    place[order] = at
    sizes = np.repeat(np.diff(np.r_[first, n]), np.diff(np.r_[first, n]))
    open_ = order[sizes > 1]  # suffixes that still share their place with others
    step = 1
    while len(open_):
        nxt = np.where(open_ + step < n, place[np.minimum(open_ + step, n - 1)], -1)
        by = np.lexsort((nxt, place[open_]))
        open_, nxt = open_[by], nxt[by]
        group = place[open_]
        new_group = np.r_[True, np.diff(group) != 0]
        new_part = new_group | np.r_[True, np.diff(nxt) != 0]
        index = np.arange(len(open_))
        part = np.flatnonzero(new_part)
        counts = np.diff(np.r_[part, len(open_)])
        group_start = np.maximum.accumulate(np.where(new_group, index, 0))
        place[open_] = group + np.repeat(part, counts) - group_start
        open_ = open_[np.repeat(counts, counts) > 1]
        step *= 2
    result = np.empty(n, np.int64)
    result[place] = np.arange(n)
    return result


class Wavelet:
    """Ranks of symbols in a sequence, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        rest = symbols
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (rest >> shift) & 1
            ones = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, len(rest) - int(ones[-1])))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros_like(end)
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        symbol, start, end = np.zeros_like(at), np.zeros_like(at), at
        for shift, ones, zeros in self.levels:
            one = (ones[end + 1] - ones[end]).astype(bool)
            symbol = symbol | (one.astype(symbol.dtype) << shift)
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return symbol, end - start


class FMIndex:
    """Index of several word runs. Words are ids from 1; 0 ends each run and never occurs in a pattern."""

    def __init__(self, words: np.ndarray, n_words: int, sample: int = 16):
        """``words``: runs of ids, each run ended by 0; ``n_words``: the largest id."""
        n = len(words)
        ends = words == 0
        n_ends = int(ends.sum())
        rank = words.astype(np.int64) + n_ends
        rank[ends] = np.arange(n_ends)[::-1]  # every end differs, the last is least: ties stop within a run
        order = suffix_order(rank)
        self.n = n
        before = np.where(order > 0, words[order - 1], 0)
        self.wavelet = Wavelet(before, n_words + 1)
        self.starts = np.r_[0, np.cumsum(np.bincount(words, minlength=n_words + 1))]
        # Positions at multiples of `sample` and at the start of runs are kept; walks never leave a run.
        kept = (order % sample == 0) | (before == 0)
        self.kept_before = np.r_[0, np.cumsum(kept)]
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns of one length, a row of ids each, from the last word backwards."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k].astype(np.int64)
            low = self.starts[c] + self.wavelet.rank(c, low)
            high = self.starts[c] + self.wavelet.rank(c, high)
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, by walking back to a kept one."""
        result = np.zeros(len(rows), np.int64)
        index, steps = np.arange(len(rows)), 0
        while len(rows):
            at = self.kept_before[rows]
            found = self.kept_before[rows + 1] > at
            result[index[found]] = self.positions[at[found]] + steps
            index, rows = index[~found], rows[~found]
            symbol, before = self.wavelet.symbol_and_rank(rows)
            rows = self.starts[symbol] + before
            steps += 1
        return result
