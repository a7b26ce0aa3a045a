"""Hashed text features and linear scores of the language classifier.

A text's feature vector is the share of each of ``DIM`` hash bins among its byte trigrams. A linear score is then the mean over the items of the bin's weight, so it
is summed over whole texts without a vector per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernels import SLICE_BYTES, text_buffer

DIM = 4096
_LETTERS = np.array([c if chr(c).isascii() and chr(c).isalpha() or c > 127 else 32 for c in range(256)], np.uint32)


def trigram_bins(column):
    """Yields (first document, counts by document, bins) over slices of the lower-cased texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, off = text_buffer(pc.utf8_lower(column))
    d, n = 0, len(off) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(off, off[d] + SLICE_BYTES, "right")) - 1)
        o = off[d : e + 1] - off[d]
        b = _LETTERS[data[off[d] : off[e]]]
        at = np.arange(max(0, len(b) - 2))
        doc = np.repeat(np.arange(e - d), np.diff(o))
        at = at[(doc[: len(at)] == doc[2:]) & ((b[: len(at)] != 32) | (b[1 : len(at) + 1] != 32))] if len(at) else at
        code = (b[at] << 16 | b[at + 1] << 8 | b[at + 2]) if len(at) else np.zeros(0, np.uint32)
        bins = (code * np.uint32(2654435761)) >> np.uint32(20)
        yield d, np.bincount(doc[at], minlength=e - d) if len(at) else np.zeros(e - d, np.int64), bins
        d = e


def shares(column, bins=trigram_bins) -> list[bytes]:
    """Feature vectors as bytes of float16 (of the square root, to keep rare bins)."""
    out = []
    for _, counts, b in bins(column):
        ends = np.cumsum(counts)
        for n, e in zip(counts.tolist(), ends.tolist()):
            out.append(np.sqrt(np.bincount(b[e - n : e], minlength=DIM) / max(n, 1)).astype(np.float16).tobytes())
    return out


def mean_weights(column, weights: np.ndarray, bins=trigram_bins):
    """(items by document, mean weight by document and column of ``weights[DIM, k]``)."""
    ns, means = [], []
    for _, counts, b in bins(column):
        k, n = weights.shape[1], len(counts)
        out = np.zeros((n, k))
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            for c in range(k):
                out[some, c] = np.add.reduceat(weights[b, c], starts)
        ns.append(counts)
        means.append(out / np.maximum(counts, 1)[:, None])
    return (np.concatenate(ns), np.concatenate(means)) if ns else (np.zeros(0, np.int64), np.zeros((0, weights.shape[1])))


def squared_hinge(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss) by accelerated gradient descent; y is +1 or -1."""
    w, v, b, bv, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0, 1.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (2 * ((weight[:, None] * x * x).sum() + 1) + ridge)
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v + bv)) * y * weight
        nw, nb = v - step * (ridge * v - 2 * (x.T @ gap)), bv + step * 2 * gap.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, bv, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return w, b
