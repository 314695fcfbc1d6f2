"""Byte-pair merging of many short sequences at once, as ragged numpy arrays.

Every round finds the lowest-rank pair of each sequence (the leftmost of equal ones) and merges all
of them simultaneously; a sequence without a mergeable pair leaves. Sequences above `LONG` symbols
would make many rounds, so they are merged one by one with a queue, with the same result.
"""

from __future__ import annotations

import heapq

import numpy as np

LONG = 192
_NONE = np.int64(1) << np.int64(30)


class Pairs:
    """Which two symbols merge, at which rank, into which symbol."""

    def __init__(self, left, right, rank, new):
        key = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.new = key[order], np.asarray(rank, np.int64)[order], np.asarray(new, np.int64)[order]

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key) or not len(a):
            return np.full(len(a), _NONE), np.zeros(len(a), np.int64)
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], _NONE), self.new[at]

    def lookup(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_dict"):
            self._dict = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.new.tolist())))
        return self._dict


def merge_one(symbols: list[int], pairs: Pairs) -> list[int]:
    """One sequence, by a queue of its pairs over a linked list."""
    table, sym, n = pairs.lookup(), list(symbols), len(symbols)
    after, before, queue = [*range(1, n), -1], [*range(-1, n - 1)], []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (found := table.get(sym[i] << 32 | sym[j])):
            heapq.heappush(queue, (found[0], i, sym[i], sym[j], found[1]))

    for i in range(n):
        offer(i)
    while queue:
        _, i, a, b, new = heapq.heappop(queue)
        j = after[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j], after[i] = new, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in sym if s != -1]


def merge(sym: np.ndarray, off: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of the sequences sym[off[i]:off[i+1]], and their offsets."""
    n, size = len(off) - 1, np.diff(off)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r in np.flatnonzero(size > LONG):
        got = np.array(merge_one(sym[off[r]: off[r + 1]].tolist(), pairs), np.int64)
        out.append((np.array([r]), np.array([len(got)]), got))
    rows = np.flatnonzero((size > 0) & (size <= LONG))
    size = size[rows]
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    sym = sym[np.repeat(off[rows] - begin, size) + np.arange(size.sum())].astype(np.int64)
    last = np.zeros(len(sym), bool)
    last[begin + size - 1] = True
    rank, new = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
    at = np.flatnonzero(~last)
    rank[at], new[at] = pairs.find(sym[at], sym[at + 1])
    while len(rows):
        best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), begin)
        done = best >= (_NONE << 32)
        stays = ~done
        keep = np.repeat(stays, size)
        if done.any():
            out.append((rows[done], size[done], sym[~keep]))
        p = best[stays] & 0xFFFFFFFF
        sym[p] = new[p]
        last[p] = last[p + 1]
        keep[p + 1] = False
        place = np.cumsum(keep) - 1
        q = place[p]
        sym, rank, new, last = sym[keep], rank[keep], new[keep], last[keep]
        rows, size = rows[stays], size[stays] - 1
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        if not len(rows):
            break
        for at, ok in ((q, ~last[q]), (q - 1, q > begin)):
            rank[at[~ok & (at >= begin)]] = _NONE
            at = at[ok]
            rank[at], new[at] = pairs.find(sym[at], sym[at + 1])
    total = np.zeros(n, np.int64)
    for r, s, _ in out:
        total[r] = s
    place = np.concatenate([[0], np.cumsum(total)])
    merged = np.empty(place[-1], np.int64)
    for r, s, x in out:
        lead = np.concatenate([[0], np.cumsum(s)])[:-1]
        merged[np.repeat(place[r] - lead, s) + np.arange(s.sum())] = x
    return merged, place
