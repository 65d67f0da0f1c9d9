"""Vectorised hashing of words and byte windows in numpy; called on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at a time, so that what is worked out of them stays in a core's cache; a longer text is a chunk of its own.
CHUNK = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 4096)
            self.up = powers(size)
            self.down = powers(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        return self.up, self.down


_POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """q with q[i] the sum of (byte + 1) * base**j over j < i; windows follow by subtraction."""
    up, _ = _POWERS.get(len(data) + 1)
    q = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=q[1:])
    return q


def window_hash(q: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unscrambled hash of the bytes start to end, the same wherever they stand."""
    _, down = _POWERS.get(len(q))
    return (q[end] - q[start]) * down[start]


def all_windows(data: np.ndarray, size: int) -> np.ndarray:
    """window_hash of the size bytes from every place on."""
    q = prefix_sums(data)
    _, down = _POWERS.get(len(q))
    return (q[size:] - q[:-size]) * down[: len(data) - size + 1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty), and where each row begins and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, at


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most that many bytes, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: Also ASCII punctuation and symbols.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def words(raw: np.ndarray, bounds: np.ndarray, marks: bool = False, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Words [^\\x20\\x09-\\x0D]+ of the rows that bounds marks in raw, A-Z lower-cased: their hashes, and how many each row has.

    marks: ASCII punctuation separates words too. prefix: also gives hashes of each word's first bytes, that many.
    """
    lo, hi = int(bounds[0]), int(bounds[-1])
    data = raw[lo:hi]
    rows = len(bounds) - 1
    if not len(data):
        none = np.zeros(0, dtype=np.uint64), np.zeros(rows, dtype=np.int64)
        return (*none, none[0]) if prefix else none
    data = _LOWER[data]
    gap = (_MARKS if marks else _SPACE)[data]
    begins = ~gap
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds - lo] = True
    start = begins.copy()
    start[1:] &= gap[:-1] | edge[1:-1]
    ends = begins.copy()
    ends[:-1] &= gap[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(ends) + 1
    q = prefix_sums(data)
    h = mix(window_hash(q, s, e) + (e - s).astype(np.uint64))
    counts = np.diff(np.searchsorted(s, bounds - lo))
    return (h, counts, mix(window_hash(q, s, np.minimum(s + prefix, e)))) if prefix else (h, counts)


def shingles(h: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within each row (a shorter row is one run; one without words has none), and how many each row has."""
    each = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    full = np.flatnonzero(counts >= n)
    out = np.zeros(int(each.sum()), dtype=np.uint64)
    to = np.concatenate([[0], np.cumsum(each)])[:-1]
    if len(h) >= n:
        s = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            s = mix(s * _BASE + h[k : len(h) - n + 1 + k])
        pick = ranges(starts[full], each[full])
        out[ranges(to[full], each[full])] = s[pick]
    for few in range(1, n):  # short rows: all their words as one run
        rows = np.flatnonzero(counts == few)
        x = h[starts[rows]]
        for k in range(1, few):
            x = mix(x * _BASE + h[starts[rows] + k])
        out[to[rows]] = mix(x + np.uint64(few))
    return out, each


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... of each length in turn."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, dtype=np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)
