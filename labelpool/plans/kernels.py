"""Distances between two small blocks of vectors, used inside tasks by plans/blocks.py."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

TILE_BYTES = 32 << 20


def _from_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by one matrix product; close pairs are redone by difference."""
    sq_a = np.einsum("ij,ij->i", a, a)
    sq_b = np.einsum("ij,ij->i", b, b)
    scale = sq_a[:, None] + sq_b[None, :]
    out = scale - 2.0 * (a @ b.T)
    rows, cols = np.nonzero(out <= 1e-4 * scale)
    step = max(1, TILE_BYTES // (8 * max(1, a.shape[1])))
    for start in range(0, len(rows), step):
        r, c = rows[start : start + step], cols[start : start + step]
        gap = a[r] - b[c]
        out[r, c] = np.einsum("ij,ij->i", gap, gap)
    return out


def _by_difference(reduce: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Apply ``reduce`` to broadcast rows, a few rows of ``a`` at a time."""

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(b)))
        step = max(1, TILE_BYTES // max(1, 8 * b.size))
        for start in range(0, len(a), step):
            out[start : start + step] = reduce(a[start : start + step, None, :], b[None, :, :])
        return out

    return run


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return 1.0 - (a @ b.T) / lengths


def _correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _cosine(a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True))


def _canberra(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    weight = np.abs(p) + np.abs(q)
    return np.divide(np.abs(p - q), weight, out=np.zeros_like(weight), where=weight > 0).sum(-1)


def _jaccard(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    present = ((p != 0) | (q != 0)).sum(-1).astype(float)
    differ = (p != q).sum(-1)
    return np.divide(differ, present, out=np.zeros_like(present), where=present > 0)


def _jensenshannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    p = p / p.sum(-1, keepdims=True)
    q = q / q.sum(-1, keepdims=True)
    half = (p + q) / 2.0

    def part(share: np.ndarray) -> np.ndarray:
        share, mid = np.broadcast_arrays(share, half)
        out = np.where(share == 0, 0.0, np.nan)
        ok = (share > 0) & (mid > 0)
        out[ok] = share[ok] * np.log(share[ok] / mid[ok])
        return out.sum(-1)

    return np.sqrt(np.maximum(part(p) + part(q), 0.0) / 2.0)


def _counted(formula):
    """A distance from how often both, one or neither of two positions are non-zero."""

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = (a != 0).astype(float), (b != 0).astype(float)
        tt = p @ q.T
        tf = p.sum(1)[:, None] - tt
        ft = q.sum(1)[None, :] - tt
        return formula(tt, tf, ft, a.shape[1] - tt - tf - ft)

    return run


def _yule(tt, tf, ft, ff):
    mixed = tf * ft
    return np.where(mixed == 0, 0.0, 2 * mixed / np.where(mixed == 0, 1.0, tt * ff + mixed))


BLOCK_DISTANCES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda a, b: np.sqrt(_from_products(a, b)),
    "sqeuclidean": _from_products,
    "cityblock": _by_difference(lambda p, q: np.abs(p - q).sum(-1)),
    "chebyshev": _by_difference(lambda p, q: np.abs(p - q).max(-1)),
    "minkowski": lambda a, b: np.sqrt(_from_products(a, b)),
    "canberra": _by_difference(_canberra),
    "braycurtis": _by_difference(lambda p, q: np.abs(p - q).sum(-1) / np.abs(p + q).sum(-1)),
    "cosine": _cosine,
    "correlation": _correlation,
    "hamming": _by_difference(lambda p, q: (p != q).mean(-1)),
    "matching": _by_difference(lambda p, q: (p != q).mean(-1)),
    "jaccard": _by_difference(_jaccard),
    "jensenshannon": _by_difference(_jensenshannon),
    "dice": _counted(lambda tt, tf, ft, ff: (tf + ft) / (2 * tt + tf + ft)),
    "rogerstanimoto": _counted(lambda tt, tf, ft, ff: 2 * (tf + ft) / (tt + ff + 2 * (tf + ft))),
    "sokalmichener": _counted(lambda tt, tf, ft, ff: 2 * (tf + ft) / (tt + ff + 2 * (tf + ft))),
    "russellrao": _counted(lambda tt, tf, ft, ff: (tf + ft + ff) / (tt + tf + ft + ff)),
    "sokalsneath": _counted(lambda tt, tf, ft, ff: 2 * (tf + ft) / (tt + 2 * (tf + ft))),
    "yule": _counted(_yule),
    # Without any mismatch it is undefined, as in the column form.
    "kulczynski1": _counted(lambda tt, tf, ft, ff: np.where(tf + ft == 0, np.nan, tt / (tf + ft))),
    "kulsinski": _counted(
        lambda tt, tf, ft, ff: (2 * (tf + ft) + ff) / (2 * (tf + ft) + ff + tt)
    ),
}


def block_distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of ``a`` and ``b``; undefined ones are NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return BLOCK_DISTANCES[metric](a, b)
