"""Character windows of texts as flat arrays, cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
#: Merged counts wait until so many are together.
PENDING = 400_000
_LIMIT = 0x110000
_tables: dict[str, np.ndarray] = {}


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, a few hundred at a time, so that few are held twice."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


class Counts:
    """Counts of numbers that arrive in parts; merged as they come, so memory follows the
    different ones."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, numbers: np.ndarray) -> None:
        self.parts.append(np.unique(numbers, return_counts=True))
        self.pending += len(self.parts[-1][0])
        if self.pending > PENDING:
            merged = self.all()
            self.parts, self.pending = [merged], 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """``(distinct numbers, counts)``."""
        if len(self.parts) == 1:
            return self.parts[0]
        keys = np.concatenate([k for k, _ in self.parts])
        distinct, inverse = np.unique(keys, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([c for _, c in self.parts])).astype(np.int64)
        return distinct, n


def tables() -> tuple[np.ndarray, np.ndarray]:
    """``(folded, letter)`` by code point: the lower-case letter, or a blank for anything else."""
    if not _tables:
        folded = np.full(_LIMIT, 32, np.uint32)
        letter = np.zeros(_LIMIT, bool)
        for c in range(_LIMIT):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                folded[c], letter[c] = ord(low) if len(low) == 1 else c, True
        _tables.update(folded=folded, letter=letter)
    return _tables["folded"], _tables["letter"]


def pieces(texts: Iterable[str | None], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(code points, owner)`` of about PIECE characters together.

    Every text is led by one blank. A long text continues in the next piece, which repeats its
    last ``overlap`` characters, so every window of ``overlap + 1`` characters is seen once.
    """
    parts: list[str] = []
    owners: list[int] = []
    sizes: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        text = " " + text
        at = 0
        while True:
            part = text[at : at + max(PIECE - held, overlap + 1)]
            parts.append(part)
            owners.append(i)
            sizes.append(len(part))
            held += len(part)
            done = at + len(part) >= len(text)
            at += len(part) - overlap
            if held >= PIECE:
                yield _joined(parts, owners, sizes)
                parts, owners, sizes, held = [], [], [], 0
            if done:
                break
    if parts:
        yield _joined(parts, owners, sizes)


def _joined(parts, owners, sizes):
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.repeat(np.array(owners, np.int64), sizes)
