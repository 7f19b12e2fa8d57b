"""Vectorised word scanning over the UTF-8 buffers of Arrow string columns.

Separators are ASCII bytes, so whole texts are cut without decoding. Every word gets a 64-bit hash
from prefix sums of a polynomial over randomised bytes, finished with an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20
SLICE = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, m, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _GRAMS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)
_R = _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of op3, op5 and op7: everything but space and the bytes 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Words of op1 after lower-casing: digits, a-z and everything outside ASCII.
MARKS = np.ones(256, bool)
MARKS[128:] = False
MARKS[48:58] = False
MARKS[97:123] = False


class Words:
    """Words of some rows: byte ranges in ``data``, hashes, and ``first[i]:first[i+1]`` for row i."""

    __slots__ = ("data", "start", "end", "hash", "first")

    def __init__(self, data, start, end, hashes, first):
        self.data, self.start, self.end, self.hash, self.first = data, start, end, hashes, first


def _pieces(data: np.ndarray, cuts: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end at a separator or at the end of a row."""
    at, n = 0, len(data)
    while at < n:
        to = at + PIECE
        if to >= n:
            yield at, n
            return
        row = int(cuts[np.searchsorted(cuts, to, "right") - 1])
        if row > at:
            to = row
        else:
            gap = np.flatnonzero(sep[data[at:to]])
            while not len(gap) and to < n:
                step = min(n, to + PIECE)
                gap = np.flatnonzero(sep[data[to:step]]) + (to - at)
                to = step
            to = at + int(gap[-1]) + 1 if len(gap) else n
        yield at, to
        at = to


def scan(column: pa.Array, sep: np.ndarray, lower: bool = False) -> Words:
    """Words of a string column; nulls have none."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    cuts = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    starts, ends, hashes = [], [], []
    for a, b in _pieces(data, cuts, sep):
        d = data[a:b]
        m = ~sep[d]
        lo, hi = np.searchsorted(cuts, [a, b])
        edge = cuts[lo:hi] - a
        before = np.empty_like(m)
        before[0], before[1:] = False, m[:-1]
        before[edge[edge < len(m)]] = False
        s = np.flatnonzero(m & ~before)
        after = np.empty_like(m)
        after[-1], after[:-1] = False, m[1:]
        after[edge[edge > 0] - 1] = False
        e = np.flatnonzero(m & ~after) + 1
        up, down = _BYTES.upto(len(d) + 1)
        sums = np.zeros(len(d) + 1, U)
        np.cumsum(_R[d] * up[:-1], out=sums[1:])
        hashes.append(_mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U)))
        starts.append(s + a)
        ends.append(e + a)
    if not starts:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(cuts), np.int64))
    start = np.concatenate(starts)
    return Words(data, start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, cuts))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive hashes."""
    if len(h) < k:
        return np.zeros(0, U)
    up, down = _GRAMS.upto(len(h) + 1)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[:-1], out=sums[1:])
    n = len(h) - k + 1
    return _mix((sums[k:] - sums[:n]) * down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    n, have, m = len(x) - w + 1, 1, x
    while have * 2 <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[w - have : w - have + n])


def slices(batch: pa.RecordBatch, text: int = 1, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text, at least one row each."""
    n = batch.num_rows
    if not n:
        return
    column = batch.column(text).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words_hash(words: list[bytes]) -> np.ndarray:
    """The same hashes for single words."""
    out = np.empty(len(words), U)
    for i, w in enumerate(words):
        d = np.frombuffer(w, np.uint8)
        up, _ = _BYTES.upto(len(d) + 1)
        out[i] = (_R[d] * up[:-1]).sum(dtype=U) + U(len(d))
    return _mix(out)
