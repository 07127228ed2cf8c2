"""DartMinHash signatures of weighted sets.

Every element owns a strip of weight by rank. Its weight axis is cut into regions [2^v - 1, 2^(v+1) - 1), and hashed darts
fall on each region as a Poisson process in rank: gaps are exponential with the region's width as rate, and each dart has a
hashed height in the region. A set is hit by the darts below its weight. Each dart also names one of ``k`` coordinates, and
a signature holds, per coordinate, the dart of the lowest rank. Darts depend on elements alone, so two sets agree in a
coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from .arrow import mix

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_HEIGHT = np.uint64(0xA5A5A5A5A5A5A5A5)
_UNIT = 1.0 / (1 << 53)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """(n_sets, k) dart ids, 0 rows for sets without weight.

    ``owner`` numbers the set of each (element hash, weight). Darts are thrown up to a rank at which most coordinates are
    hit; sets with an empty coordinate throw on to twice that rank, until none is empty.
    """
    total = np.bincount(owner, weight, n_sets)
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    best = np.full(n_sets * k, np.inf)
    sign = np.zeros(n_sets * k, np.uint64)
    # One process per element and region; `state` and `rank` are its next dart.
    top = np.floor(np.log2(weight + 1 - 1e-12)).astype(np.int64) if len(weight) else np.zeros(0, np.int64)
    count = np.maximum(top, 0) + 1
    who = np.repeat(np.arange(len(owner)), count)
    region = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    sets, heights = owner[who], weight[who]
    width, base = np.exp2(region), np.exp2(region) - 1
    state = mix(element[who].astype(np.uint64) + _GOLDEN * (region.astype(np.uint64) + np.uint64(1)))
    state = mix(state + _GOLDEN)
    rank = -np.log(_uniform(state)) / width
    while True:
        live = np.flatnonzero(rank < limit[sets])
        while len(live):
            own = state[live]
            hit = base[live] + _uniform(mix(own ^ _HEIGHT)) * width[live] < heights[live]
            _keep(best, sign, sets[live][hit], rank[live][hit], own[hit], k)
            own = mix(own + _GOLDEN)
            state[live] = own
            rank[live] -= np.log(_uniform(own)) / width[live]
            live = live[rank[live] < limit[sets[live]]]
        empty = np.isinf(best).reshape(n_sets, k).any(1) & (total > 0)
        if not empty.any():
            return sign.reshape(n_sets, k)
        stay = empty[sets]
        sets, heights, width, base, state, rank = sets[stay], heights[stay], width[stay], base[stay], state[stay], rank[stay]
        limit = np.where(empty, 2 * limit, limit)


def _keep(best: np.ndarray, sign: np.ndarray, sets: np.ndarray, rank: np.ndarray, dart: np.ndarray, k: int) -> None:
    """Per set and coordinate, the dart of the lowest rank (ties to the smaller dart)."""
    slot = sets * k + (mix(dart + _GOLDEN) % np.uint64(k)).astype(np.int64)
    old = best[slot]
    better = rank < old
    slot, rank, dart = slot[better], rank[better], dart[better]
    np.minimum.at(best, slot, rank)
    won = best[slot] == rank
    sign[slot[won]] = dart[won]
