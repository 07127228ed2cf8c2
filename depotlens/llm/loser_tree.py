"""Merging front-coded sorted runs with a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share their first ``known`` bytes."""
    n, step = min(len(a), len(b)), 32
    while known + step <= n and a[known:known + step] == b[known:known + step]:
        known += step
    while known < n and a[known] == b[known]:
        known += 1
    return known


def merge(runs: list[Iterable[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merge runs of (bytes shared with the string before it in the run, string, payload), each ascending.

    What comes out has the same form: the first number is what a string shares with the one before it in the merged order.

    Every waiting string carries the length of the prefix it shares with the last winner that passed its node. Of two such
    strings the one with more in common with that winner is the smaller one, without looking at a byte; only at a draw are
    bytes compared, and only those behind the known prefix.
    """
    streams = [iter(r) for r in runs]
    heads: list = [next(s, None) for s in streams]
    size = 1
    while size < max(1, len(streams)):
        size *= 2
    heads += [None] * (size - len(heads))
    shared = [0] * size
    tree = [-1] * size  # the loser at each inner node; the winner's path goes up by halving

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes what it shares with the winner."""
        if heads[y] is None:
            return x, y
        if heads[x] is None:
            return y, x
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        a, b = heads[x][1], heads[y][1]
        k = common_prefix(a, b, shared[x])
        if a[k:k + 1] <= b[k:k + 1]:
            shared[y] = k
            return x, y
        shared[x] = k
        return y, x

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        rising = []
        for node in range(level):
            w, loser = play(winners[2 * node], winners[2 * node + 1])
            tree[level + node] = loser
            rising.append(w)
        winners = rising
    top = winners[0]
    while heads[top] is not None:
        yield (shared[top], *heads[top][1:])
        heads[top] = next(streams[top], None) if top < len(streams) else None
        if heads[top] is not None:
            shared[top] = heads[top][0]
        node = (size + top) // 2
        while node:
            if tree[node] >= 0:
                top, tree[node] = play(top, tree[node])
            node //= 2
