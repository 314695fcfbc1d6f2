"""Words of texts as numpy arrays, a whole Arrow batch at a time.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return; A-Z are lower-cased first. A word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text hashed at a time (a longer text is one piece of its own); a worker takes some 50 times as much.
SLICE = 1 << 18
_tables: list[np.ndarray] = []


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable) -> Callable:
    """`run` for mapInArrow; a worker whose task is over waits for the next one without the memory of the last."""
    @wraps(run)
    def each(batches):
        yield from run(batches)
        give_back()

    return each


def lean_group(run: Callable) -> Callable:
    """The same for applyInPandas, after every group."""
    @wraps(run)
    def each(group):
        out = run(group)
        give_back()
        return out

    return each


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 2 * SLICE)
        out = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        _tables[:] = out
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `limit` bytes each, at least one row."""
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(n, to)
        at = min(n, to)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: hash, row, start and end of every word, and the lower-cased bytes."""
    low = _LOWER[raw]
    inside = ~_BLANK[low]
    n = len(low)
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix(((total[e] - total[s]) * down[s]) ^ (e - s).astype(np.uint64))
    return h, np.searchsorted(off, s, "right") - 1, s, e, low


def hashed(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, word hashes, row of each word counted from the first)."""
    raw, off = parts(texts)
    for a, b in slices(off):
        h, row, *_ = words(raw[off[a]: off[b]], off[a: b + 1] - off[a])
        yield a, b, h, row


def shingle_sets(h: np.ndarray, row: np.ndarray, n: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `width` words for each of n rows: hashes sorted by row, and n+1 offsets.
    A row of fewer words has its whole sequence as one; a row without words has none."""
    count = np.bincount(row, minlength=n)
    begin = np.concatenate([[0], np.cumsum(count)])
    one, two = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
    many = np.maximum(count - width + 1, 0)
    at = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    key = np.full(len(at), two, np.uint64)
    for k in range(width):
        key = mix(key * one + h[at + k]) if len(at) else key
    owner = np.repeat(np.arange(n), many)
    for short in range(1, width):
        rows = np.flatnonzero(count == short)
        k = np.full(len(rows), two ^ np.uint64(short), np.uint64)
        for j in range(short):
            k = mix(k * one + h[begin[rows] + j])
        key, owner = np.concatenate([key, k]), np.concatenate([owner, rows])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[keep], owner[keep]
    return key, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
