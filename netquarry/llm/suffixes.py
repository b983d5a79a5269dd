"""Suffix arrays by linear grouping construction, and the byte arithmetic around them (operator 6).

Suffixes are grouped by their longest Lyndon prefix. Groups are taken from the largest to the smallest;
each group's members point to the nearest earlier suffix in a smaller group, and those pointed to leave their
own group, more pointers further up, for a new group right after it. Then one pass from the smallest suffix
on puts each suffix's predecessor, and those it points back to, at the front of its group. Nothing is sorted
or renamed recursively.
"""

from __future__ import annotations

import numpy as np

#: Random odd numbers for bytes and a base, for polynomial hashes modulo 2^64.
_RNG = np.random.default_rng(7)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0 to n, and its inverses, modulo 2^64."""
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """Hashes of substrings [a, b) of a byte array, for arrays of bounds."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of a list of integers from 0 up, of which the last is the one smallest."""
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    where, group, end = [0] * n, [0] * n, [0] * n
    start = 0
    for k in range(1, n + 1):
        if k == n or symbols[order[k]] != symbols[order[start]]:
            for p in range(start, k):
                where[order[p]], group[order[p]] = p, start
            end[start] = k
            start = k
    before = [-1] * n
    top = n
    while top > 0:
        first = group[order[top - 1]]
        members = order[first:top]
        top = first
        # In the order of the text, so that an equal group's pointer further left is known.
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[c]:
                g = group[j]
                last = moved.get(g, end[g]) - 1
                moved[g] = last
                p, other = where[j], order[last]
                order[p], order[last] = other, j
                where[other], where[j] = p, last
            for j in by_count[c]:
                # The moved ones stand at the end of their group; it may move as a whole.
                g = group[j]
                if g in moved and moved[g] > g:
                    group[j] = moved[g]
            for g, s in moved.items():
                if s > g:
                    end[s], end[g] = end[g], s
    out, head = [-1] * n, list(range(n))
    placed = [False] * n
    out[group[n - 1]] = n - 1
    placed[n - 1] = True
    head[group[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[head[g]] = j
            head[g] += 1
            placed[j] = True
            j = before[j]
    return out


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of so many neighbours."""
    most = np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)
    cut = np.concatenate([x, most]).reshape(-1, width)
    ahead = np.minimum.accumulate(cut, axis=1).reshape(-1)
    back = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1: width - 1 + n])
