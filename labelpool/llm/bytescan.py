"""Vectorised scans of text bytes inside tasks: words, hashes, and per-document segments.

Texts arrive as Arrow string columns, whose bytes already lie in one flat buffer. Everything here
works on such a buffer in windows of bounded size, so the memory of a task does not depend on how
long a text is beyond the text itself and eight bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0x2545F4914F6CDD1D
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for the bytes of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = byte_class((0x20, 0x20), (0x09, 0x0D))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; NULL is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        inverse = pow(_PRIME, -1, 1 << 64)
        for name, base in (("up", _PRIME), ("down", inverse)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray, lower: bool = True):
    """``(hash, start, end, doc)`` of every maximal run of non-blank bytes inside one text."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edges = np.asarray(offsets[1:-1])
    # What separates words is decided after lower-casing, also where a window is cut.
    blank = blank[LOWER] if lower else blank
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + WINDOW)
        if stop < n:
            stop = _cut(data, offsets, blank, at, stop)
        part = data[at:stop]
        solid = ~blank[part]
        if lower:
            part = LOWER[part]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        inner = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, stop)] - at
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power(max(len(part), 1))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up, out=total[1:])
        out.append((mix((total[hi] - total[lo]) * down[lo]), lo + at, hi + at))
        at = stop
    if not out:
        nothing = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), nothing, nothing, nothing
    h, lo, hi = (np.concatenate(x) for x in zip(*out))
    return h, lo, hi, np.searchsorted(offsets, lo, "right") - 1


def _cut(data, offsets, blank, at, stop):
    """The last place up to ``stop`` where no word is cut, else the first place after it."""
    k = int(np.searchsorted(offsets, stop, "right")) - 1
    best = int(offsets[k]) if offsets[k] > at else at
    gaps = np.flatnonzero(blank[data[max(best, stop - 4096) : stop]])
    if len(gaps):
        best = max(best, max(best, stop - 4096) + int(gaps[-1]) + 1)
    if best > at:
        return best
    limit = int(offsets[k + 1])
    for low in range(stop, limit, WINDOW):
        gaps = np.flatnonzero(blank[data[low : min(limit, low + WINDOW)]])
        if len(gaps):
            return low + int(gaps[0]) + 1
    return limit


def hash_word(word: str) -> int:
    """The hash that ``words`` gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)]), np.zeros(256, bool), lower=False)[0][0])


def groups_of(offsets: np.ndarray, limit: int):
    """Ranges of consecutive texts of about ``limit`` bytes together; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        stop = min(n, max(stop, at + 1))
        yield at, stop
        at = stop


def per_doc(offsets_or_counts: np.ndarray) -> np.ndarray:
    """Offsets from counts."""
    out = np.zeros(len(offsets_or_counts) + 1, np.int64)
    np.cumsum(offsets_or_counts, out=out[1:])
    return out
